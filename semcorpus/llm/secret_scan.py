"""Secret scan that unwraps nested encodings.

Each text starts a worklist of layers. A layer is searched for secrets, then whatever is encoded in it is decoded
into further layers: percent escapes, Unicode escapes, base64 runs, and data inside any of them that is compressed with
gzip, zlib, bz2 or xz, or as a whole by raw deflate. A layer already seen at the same place is dropped, so the list ends. A
layer knows for each of its characters the place in the original text that it came from; what is found is reported there. A
run may have other text before it, so base64 is decoded from each of its first four characters on, and whatever comes out is
searched: bytes that are not UTF-8 stand for themselves and hide nothing beside them. An escape of an escape of an escape
(`%252541`) is unwrapped to the last one in one step, so a long chain costs no layer for each of its links.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Generator, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.llm.batches import extend, free_name

# The kinds in their order, and what each looks like.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

# An escape, with the links of a chain before its last one as first group.
PERCENT = re.compile(r"%((?:25)*)([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"\\((?:u005[Cc]|U0000005[Cc]|x5[Cc])*)(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
# Runs go on over line breaks.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\r\n?|\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
BLANKS = re.compile(r"[ \t\r\n]")
# No secret, and no code of one, has fewer characters.
LEAST_LAYER = 12
# Where gzip, zlib, bz2 or xz data may begin.
BZ2, XZ = re.compile(rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)"), re.compile(rb"\xfd7zXZ\x00")
HEADER = re.compile(b"\x1f\x8b\x08|" + BZ2.pattern + b"|" + XZ.pattern + b"|" + b"|".join(re.escape(bytes([c, f])) for c in range(8, 128, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32), re.S)
# Memory that unpacking xz data may take.
XZ_MEMORY = 1 << 28
# Stretches that may hold bytes written as percent escapes, and as the escapes of a string literal.
URL_BYTES = re.compile(r'[^\s"<>]+')
LITERAL_BYTES = re.compile(
    r"""(?<=")x?\\(?:x|u00)[0-9A-Fa-f]{2}(?:\\.|[^\\"\r\n])*|(?<=')x?\\(?:x|u00)[0-9A-Fa-f]{2}(?:\\.|[^\\'\r\n])*|x?\\(?:x|u00)[0-9A-Fa-f]{2}(?:\\.|[^\\\r\n])*"""
)
LITERAL = re.compile(rb"""\\(?:(?:x|u00)([0-9A-Fa-f]{2})|([abfnrtv0\\'"]))""")
NAMED = dict(zip(b"abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
# Unpacked data is searched in windows of so many bytes that share `OVERLAP`; data is read and written in small portions.
WINDOW, OVERLAP, READ, WRITTEN = 64 << 20, 1 << 20, 4096, 1 << 20

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("layer", T.StringType())])


def secrets(text: str) -> list[tuple[int, int, str]]:
    """(begin, stop, kind) of the secrets in plain sight, by place and kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


Places = tuple[np.ndarray, np.ndarray]


class Layer:
    """A decoded text. All of it came from `span` of the original text; `find`, if given, says for each character where it
    began and ended there. `raw` are its bytes if it was made of any."""

    def __init__(self, text: str, span: tuple[int, int], path: str, find: Callable[[], Places] | None = None, raw: bytes = b""):
        self.text, self.span, self.path, self.raw = text, span, path, raw
        self._find, self._places = find, None

    def places(self) -> Places | None:
        """Found once; a layer is asked before any other is made of it, so this never runs deep."""
        if self._find is not None:
            self._places, self._find = self._find(), None
        return self._places

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Where characters a to b came from."""
        if a == 0 and b == len(self.text):
            return self.span
        if not self.path:
            return a, b
        held = self.places()
        return self.span if held is None else (int(held[0][a]), int(held[1][b - 1]))

    def made(self, text: str, begin: np.ndarray, stop: np.ndarray, step: str) -> Layer:
        """A text made of this one; each character came from characters `begin` to `stop` here."""
        held = self.places()
        if held is None:
            return Layer(text, self.span, f"{self.path}{step}")
        starts, stops = held[0][begin], held[1][stop - 1]
        return Layer(text, (int(starts[0]), int(stops[-1])), f"{self.path}{step}", lambda: (starts, stops))

    def replaced(self, parts: list[tuple[int, int, list[tuple[str, int, int]]]], step: str) -> Layer | None:
        """This layer with each part (from, to, characters with their places in it) put in the place of its code."""
        text, begin, stop, at = [], [], [], 0
        for a, b, chars in [*parts, (len(self.text), len(self.text), [])]:
            text.append(self.text[at:a])
            begin.extend(range(at, a))
            stop.extend(range(at + 1, a + 1))
            for c, x, y in chars:
                text.append(c)
                begin += [x] * len(c)
                stop += [y] * len(c)
            at = b
        new = "".join(text)
        if not new or new == self.text:
            return None
        return self.made(new, np.array(begin, np.int64), np.array(stop, np.int64), step)


def original(text: str) -> Layer:
    return Layer(text, (0, len(text)), "", lambda: (np.arange(len(text)), np.arange(1, len(text) + 1)))


def decoded(raw: bytes) -> str:
    """The bytes as text; each byte that is not UTF-8 becomes a character of its own (a lone surrogate)."""
    return raw.decode("utf-8", "surrogateescape")


def byte_ends(text: str) -> np.ndarray:
    """Where the bytes of each character of a decoded text end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alone = (code < 0x80) | (code >= 0xDC80) & (code < 0xDD00)
    return np.cumsum(np.where(alone, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))))


def unescaped_percent(layer: Layer) -> Layer | None:
    units = [(int(m[2], 16), m.start(), m.end(), bool(m[1])) for m in PERCENT.finditer(layer.text)]
    parts, i = [], 0
    while i < len(units):
        code, a, b, chained = units[i]
        if chained:
            # The last link stays for the next layer.
            parts.append((a, b, [("%", a, b - 2), (layer.text[b - 2], b - 2, b - 1), (layer.text[b - 1], b - 1, b)]))
            i += 1
            continue
        size = 1 if code < 0x80 else 2 if code >> 5 == 6 else 3 if code >> 4 == 14 else 4 if code >> 3 == 30 else 1
        some = units[i : i + size]
        whole = len(some) == size and all(u[2] == v[1] and not v[3] for u, v in zip(some, some[1:]))
        try:
            # What is not text stays as it is.
            char = bytes([u[0] for u in some]).decode() if whole else ""
        except UnicodeDecodeError:
            char = ""
        if char:
            parts.append((a, some[-1][2], [(char, a, some[-1][2])]))
        i += size if char else 1
    return layer.replaced(parts, "url>") if parts else None


def unescaped_unicode(layer: Layer) -> Layer | None:
    units = [(int(m[2][1:], 16), m.start(), m.end(), m.start(2) if m[1] else -1) for m in ESCAPE.finditer(layer.text)]
    parts, i = [], 0
    while i < len(units):
        code, a, b, last = units[i]
        i += 1
        if last >= 0:
            parts.append((a, b, [("\\", a, last), *[(layer.text[k], k, k + 1) for k in range(last, b)]]))
            continue
        if 0xD800 <= code < 0xDC00 and i < len(units) and units[i][1] == b and units[i][3] < 0 and 0xDC00 <= units[i][0] < 0xE000:
            code, b = 0x10000 + ((code - 0xD800) << 10) + units[i][0] - 0xDC00, units[i][2]
            i += 1
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:  # else no character: the escape stays
            parts.append((a, b, [(chr(code), a, b)]))
    return layer.replaced(parts, "unicode>") if parts else None


def salvaged(reader, piece: bytes) -> bytes:
    """What a reader gives before the damage in a piece."""
    out = bytearray()
    try:
        for i in range(len(piece)):
            out += reader.decompress(piece[i : i + 1])
    except zlib.error:
        pass
    return bytes(out)


def deflated(raw: bytes, at: int) -> Generator[bytes, None, int]:
    """The data of the gzip members or the zlib stream at `at`, also of one that is damaged or cut off. Returns where to look on."""
    reader, done, tail = zlib.decompressobj(47), at + 1, b""
    while True:
        piece = tail or raw[at : at + READ]
        before = reader.copy()
        try:
            got = reader.decompress(piece, WRITTEN)
        except zlib.error:
            yield salvaged(before, piece)
            return done
        yield got
        at += 0 if tail else len(piece)
        tail = reader.unconsumed_tail
        if reader.eof:
            done = at = at - len(reader.unused_data)
            if raw[at : at + 2] != b"\x1f\x8b":
                return done
            reader, tail = zlib.decompressobj(31), b""
        elif not piece and not got:
            return done


def blocks(raw: bytes, at: int, header: re.Pattern, make: Callable) -> Generator[bytes, None, int]:
    """The data of the bz2 or xz streams at `at`, up to where they are damaged or cut off. Returns where to look on."""
    reader, done = make(), at + 1
    while True:
        piece = raw[at : at + READ] if reader.needs_input else b""
        if reader.needs_input and not piece:
            return done
        try:
            got = reader.decompress(piece, WRITTEN)
        except (OSError, EOFError, lzma.LZMAError):
            return done
        yield got
        at += len(piece)
        if reader.eof:
            done = at = at - len(reader.unused_data)
            if not header.match(raw, at):
                return done
            reader = make()


def windows(source: Generator[bytes, None, int]) -> Generator[bytes, None, int]:
    """Unpacked data in windows that overlap. Returns what the source does."""
    held, new = bytearray(), 0
    while True:
        try:
            got = next(source)
        except StopIteration as end:
            if new:
                yield bytes(held)
            return end.value
        held += got
        new += len(got)
        if len(held) >= WINDOW:
            yield bytes(held)
            del held[: max(0, len(held) - OVERLAP)]
            new = 0


def unpacked(raw: bytes, path: str, span: tuple[int, int]) -> Iterator[Layer]:
    """The texts of all compressed data in some bytes; their characters stand at the whole run."""
    at = 0
    while m := HEADER.search(raw, at):
        at = m.start()
        if BZ2.match(raw, at):
            stream = blocks(raw, at, BZ2, bz2.BZ2Decompressor)
        elif XZ.match(raw, at):
            stream = blocks(raw, at, XZ, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ, XZ_MEMORY))
        else:
            stream = deflated(raw, at)
        stream = windows(stream)
        while True:
            try:
                data = next(stream)
            except StopIteration as end:
                at = end.value
                break
            if len(data) >= LEAST_LAYER:
                yield Layer(decoded(data), span, f"{path}compressed>", raw=data)


def inflated(raw: bytes) -> Generator[bytes, None, bool]:
    """The data of a raw deflate stream. Returns whether it ends where the bytes end."""
    reader, piece = zlib.decompressobj(-15), raw
    while not reader.eof:
        got = reader.decompress(piece, WRITTEN)
        if not piece and not got:
            return False
        yield got
        piece = reader.unconsumed_tail
    return not reader.unused_data


def bare(raw: bytes, path: str, span: tuple[int, int]) -> Iterator[Layer]:
    """The text of bytes that are one raw deflate stream. It has no header, so it must end where the bytes end and be UTF-8;
    that is tried first, without holding what comes out."""
    stream, text, size = inflated(raw), codecs.getincrementaldecoder("utf-8")(), 0
    try:
        while True:
            got = next(stream)
            text.decode(got)
            size += len(got)
    except StopIteration as end:
        if not end.value or size < LEAST_LAYER or text.getstate()[0]:
            return
    except (zlib.error, UnicodeDecodeError):
        return
    for data in windows(inflated(raw)):
        yield Layer(decoded(data), span, f"{path}compressed>", raw=data)


def escaped_bytes(layer: Layer) -> Iterator[Layer]:
    """What is compressed in bytes written as percent escapes or as those of a string literal."""
    if "%" in layer.text:
        for m in URL_BYTES.finditer(layer.text):
            if "%" in m.group():
                run = m.group().encode("utf-8", "surrogateescape")
                for code in {run, run.replace(b"+", b" ")}:
                    raw = unquote_to_bytes(code)
                    if HEADER.search(raw):
                        yield from unpacked(raw, f"{layer.path}url>", layer.place(*m.span()))
    if "\\x" in layer.text or "\\u00" in layer.text:
        for m in LITERAL_BYTES.finditer(layer.text):
            run = m.group().encode("utf-8", "surrogateescape")
            raw = LITERAL.sub(lambda e: bytes([int(e[1], 16) if e[1] else NAMED[e[2][0]]]), run)
            if HEADER.search(raw):
                yield from unpacked(raw, f"{layer.path}unicode>", layer.place(*m.span()))


def opened(layer: Layer) -> Iterator[Layer]:
    """The texts in base64 runs at each of the four alignments, unpacked where they are compressed."""
    for m in BASE64.finditer(layer.text):
        run, at, spots = m.group().rstrip("="), m.start(), None
        if BLANKS.search(run):
            spots = np.array([i for i, c in enumerate(run) if c not in " \t\r\n"])
            run = "".join([run[i] for i in spots.tolist()])
        run = run.replace("-", "+").replace("_", "/")
        # Only the original text, which is made of nothing, may be asked later.
        still = layer.path and layer.places() is None
        span = layer.place(*m.span())
        for k in range(4):
            body = run[k : len(run) - ((len(run) - k) % 4 == 1)]
            if len(body) * 6 // 8 < LEAST_LAYER:
                break
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            text = decoded(raw)

            def find(at=at, k=k, spots=spots, text=text, most=len(body)) -> Places:
                y = byte_ends(text)
                x = np.concatenate([[0], y[:-1]])
                first, last = k + x * 8 // 6, k + np.minimum(most, (y * 8 - 1) // 6 + 1) - 1
                if spots is not None:
                    first, last = spots[first], spots[last]
                held = layer.places()
                return held[0][at + first], held[1][at + last]

            whole = (k, k + len(body) - 1) if spots is None else (int(spots[k]), int(spots[k + len(body) - 1]))
            yield Layer(text, layer.place(at + whole[0], at + whole[1] + 1), f"{layer.path}base64>", None if still else find)
            if HEADER.search(raw):
                yield from unpacked(raw, f"{layer.path}base64>", span)
            if k == 0:
                yield from bare(raw, f"{layer.path}base64>", span)


def deeper(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers directly within one, and whether that is the last."""
    if layer.raw:
        for new in unpacked(layer.raw, layer.path, layer.span):
            yield new, False
    for new in opened(layer):
        yield new, False
    for new in escaped_bytes(layer):
        yield new, False
    text = layer.text
    new = unescaped_percent(layer) if "%" in text else None
    other = unescaped_unicode(layer) if "\\" in text else None
    del layer
    if new:
        yield new, not other
    if other:
        yield other, True


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, stop, layer) of every secret by place and kind. `layer` is empty in the text itself, else the decodings."""
    found: dict[tuple[int, int, str], str] = {}
    # Layers within layers one at a time, and no more of those that are done, so that few are held.
    work, seen = [iter([(original(text), True)])], set()
    while work:
        layer, last = next(work[-1], (None, True))
        if last:
            work.pop()
        if layer is None or len(layer.text) < LEAST_LAYER:
            continue
        key = layer.text if len(layer.text) <= 256 else hashlib.blake2b(layer.text.encode("utf-8", "surrogateescape")).digest()
        key = (key, layer.span)
        if key in seen:
            continue
        seen.add(key)
        for a, b, kind in secrets(layer.text):
            spot = (*layer.place(a, b), kind)
            if spot not in found or found[spot].count(">") > layer.path.count(">"):
                found[spot] = layer.path
        work.append(deeper(layer))
    order = sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return [(kind, a, b, found[a, b, kind]) for a, b, kind in order]


def mark(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """Every row with an array of its secrets; returns the frame and the array's name.

    Each entry: kind, begin and stop in code points of the text (stop exclusive), and the decodings that led to it.
    Null and empty texts have none. Repeated rows get equal results.
    """
    name = free_name(df, "_secrets")

    def kernel(texts):
        rows = [[dict(zip(("kind", "begin", "stop", "layer"), s)) for s in scan(t)] if t else [] for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("layer", pa.string())]))
        return [pa.array(rows, kind)]

    return extend(df, text_col, [(name, T.ArrayType(SPAN))], kernel), name


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `secrets` of every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, name = mark(narrow)
    return out.select("doc_id", F.col(name).alias("secrets"))


def hidden(text: str | None, cover: str) -> str | None:
    """The text with every secret replaced; overlapping ones by one cover."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], cover]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", cover: str = "[REDACTED]") -> DataFrame:
    """All documents with their own columns, secrets in `text_col` replaced and `length_col` counted anew if present.

    Null and empty texts stay as they are.
    """
    name = free_name(docs, "_clean")

    def kernel(texts):
        return [pa.array([hidden(t, cover) for t in texts.to_pylist()], pa.string())]

    out = extend(docs, text_col, [(name, T.StringType())], kernel)
    changed = {text_col: F.col(name)}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col(name).eqNullSafe(F.col(text_col)), F.col(length_col)).otherwise(F.length(name)).cast(docs.schema[length_col].dataType)
    return out.select([changed.get(c, F.col(c)).alias(c) for c in docs.columns])
