"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched, and encoded piece by piece.

A long text becomes chunks that overlap. Pre-tokenising from any place falls into step with the right pieces
at the first boundary both have: what follows depends only on the text after it. So a chunk ends where its pieces
and those of the next chunk, begun at that chunk's own start, first have a boundary in common, and stitching drops
the next chunk's pieces before that place. An overlap reaches until it must hold such a boundary: the end of a run of
letters, or of one of digits, as no piece goes on after either. Chunks without one (a single piece of a million letters)
grow instead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import few_rows, lists, release, shared, slices

CHUNK = 1 << 15
OVERLAP = 256
KEPT_PIECES = 100_000
# For patterns in which a letter is followed only by letters within a piece, and a digit only by digits.
SAFE = regex.compile(r"\p{L}\P{L}|\p{N}\P{N}")
# Ids decoded at a time.
DECODED = 1 << 20


class Vocabulary:
    """Ranks and pattern of a byte-level BPE, made ready once per process for encoding or for decoding."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern
        self._encoder = self._decoder = None

    def __getstate__(self):
        return self.lines, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.lines.splitlines() if x)}

    def encoder(self) -> tuple[tiktoken.Encoding, regex.Pattern, Pieces]:
        """For whole texts; to split chunks; for single pieces."""
        if self._encoder is None:
            ranks = self.ranks()
            whole = tiktoken.Encoding("texts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            # One piece is one match, so the library applies the merges alone.
            piece = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
            self._encoder = whole, regex.compile(self.pattern), Pieces(piece)
        return self._encoder

    def decoder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens end to end, where each id begins, and its length."""
        if self._decoder is None:
            ranks = self.ranks()
            by_id = [b""] * (max(ranks.values(), default=-1) + 1)
            for token, i in ranks.items():
                by_id[i] = token
            size = np.fromiter(map(len, by_id), np.int64, len(by_id))
            self._decoder = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size
        return self._decoder


class Pieces(dict):
    """Piece to its ids as packed 32-bit numbers."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), np.int32).tobytes()
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = ids
        return ids


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The rank file at `path`, read on the driver: its size is that of a vocabulary, not of the data."""
    with open(path, "rb") as f:
        return Vocabulary(f.read(), pattern)


def packed(pieces: list[str], known: Pieces) -> bytes:
    return b"".join([known[p] for p in pieces])


def id_lists(rows: list[bytes]) -> pa.Array:
    return lists(pa.array(np.frombuffer(b"".join(rows), np.int32)), np.array([len(r) // 4 for r in rows], np.int64))


def cuts(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each chunk; an end lies `overlap` or more beyond the next begin."""
    out, begin = [], 0
    while True:
        m = SAFE.search(text, begin + chunk + overlap) if begin + chunk + overlap < len(text) else None
        if m is None or m.end() + 1 >= len(text):
            return [*out, (begin, len(text))]
        out.append((begin, m.end() + 1))
        begin += chunk if m.end() - begin < 2 * (chunk + overlap) else m.start() - begin - overlap


def bounds(pieces: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])


def meeting(pieces: list[str], text: str, at: int, pattern: regex.Pattern) -> int:
    """Where a chunk's pieces and those begun at `at` first share a boundary; both end one character before the end."""
    mine = bounds(pieces)
    theirs = at + bounds(pattern.findall(text[at:]))
    both = np.intersect1d(mine[mine < len(text) - 1], theirs[theirs < len(text) - 1], assume_unique=True)
    both = both[both >= at]
    if not len(both):
        raise ValueError("an overlap without a common boundary")
    return int(both[0])


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and `ids` of every document, special strings taken as plain text.

    Null and empty texts have no ids. Every row has its own result, also where an id repeats or is null. A caller's own
    pattern must end its pieces where `SAFE` says; else a text of several chunks may raise an error, never a wrong result.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    sent = shared(docs.sparkSession, vocab)

    def single(batches):
        whole = sent.value.encoder()[0]
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                # The library's own order of work for one chunk: split it, then encode the pieces.
                rows = [whole.encode_to_numpy(t, disallowed_special=()) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids = lists(pa.array(np.concatenate(rows).astype(np.int32)), np.array([len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["doc_id", "ids"])
        release()

    def chunked(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                row += 1
                parts = cuts(text, chunk, overlap)
                nexts = [b for b, _ in parts[1:]] + [len(text)]
                reach = [0] + [stop - begin for (_, stop), (begin, _) in zip(parts, parts[1:])]
                columns = [[row] * len(parts), list(range(len(parts))), [b for b, _ in parts], nexts, reach, [text[a:b] for a, b in parts]]
                ids = pa.chunked_array([batch.column(0).slice(i, 1)] * len(parts)).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["doc_id", "row", "part", "begin", "after", "reach", "chunk"])

    def pieces(batches):
        _, pattern, known = sent.value.encoder()
        for batch in batches:
            heads, starts, rests, stops = [], [], [], []
            for begin, after, reach, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "after", "reach", "chunk"))):
                got = pattern.findall(text)
                at = bounds(got)
                last = after - begin >= len(text)  # the chunk that ends the text
                stop = len(text) if last else meeting(got, text, after - begin, pattern)
                until = int(np.searchsorted(at, stop))
                # The chunk before ends no further than its text reaches into this one: those pieces keep their places.
                head = min(until, int(np.searchsorted(at, reach))) if reach else 0
                heads.append([packed([p], known) for p in got[:head]])
                starts.append((begin + at[:head]).tolist())
                rests.append(packed(got[head:until], known))
                stops.append((begin + int(at[head]), begin + stop))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "row", "part")],
                    pa.array(starts, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.binary())), pa.array([a for a, _ in stops], pa.int64()),
                    pa.array(rests, pa.binary()), pa.array([b for _, b in stops], pa.int64()),
                ],
                names=["doc_id", "row", "part", "starts", "heads", "rest_at", "rest", "stop"],
            )

    def stitched(table: pa.Table) -> pa.Table:
        """One text: its chunks in order, each from where the one before stops."""
        table = table.sort_by("part")
        out, reached = [], 0
        for starts, heads, rest_at, rest, stop in zip(*(table.column(c).to_pylist() for c in ("starts", "heads", "rest_at", "rest", "stop"))):
            if reached > rest_at:
                raise ValueError("a chunk claims more of the next than its head")
            out += [h for s, h in zip(starts, heads) if s >= reached]
            out.append(rest)
            reached = stop
        return pa.table([table.column("doc_id").slice(0, 1).combine_chunks(), id_lists([b"".join(out)])], names=["doc_id", "ids"])

    long = F.length("text") > chunk
    schema = f"doc_id {kind}, ids array<int>"
    short = narrow.where(~long).mapInArrow(single, schema)
    parts = narrow.where(long).mapInArrow(chunked, f"doc_id {kind}, row long, part long, begin long, after long, reach long, chunk string")
    split = parts.repartition("row", "part").mapInArrow(
        pieces, f"doc_id {kind}, row long, part long, starts array<long>, heads array<binary>, rest_at long, rest binary, stop long"
    )
    return short.unionByName(split.groupBy("row").applyInArrow(stitched, schema))


def decode_ids(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """The bytes of each list of ids, end to end. A null list has none."""
    raw, begin, size = vocab.decoder()
    flat = ids.flatten().to_numpy()
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    n = size[flat]
    ends = np.cumsum(n)
    out = raw[np.repeat(begin[flat] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def few_ids(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time, by their number and by that of their ids; a longer list is a part of its own."""
    for part in few_rows(batch):
        ends = np.cumsum(pc.fill_null(pc.list_value_length(part.column(place)), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < part.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + DECODED, side="right"))
            hi = max(hi, lo + 1)
            yield part.slice(lo, hi - lo)
            lo = hi


def decode(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids", into: str = "bytes") -> DataFrame:
    """Every row with the raw bytes of its ids. Null ids give empty bytes; repeated rows each have their own."""
    kept = encoded.drop(into)
    sent = shared(encoded.sparkSession, vocab)
    schema = kept.withColumn(into, F.lit(None).cast("binary")).schema
    place = kept.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            for part in few_ids(batch, place):
                raw = decode_ids(part.column(place), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=[*part.schema.names, into])
        release()

    return kept.mapInArrow(run, schema)


def default_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)
