"""Benchmark decontamination with suffix arrays over the training texts.

Each task orders the suffixes of its slice of the documents by their leading words (one slice is one shard of
the array), binary-searches every test suffix in all shards, reads off all places where the test words occur
verbatim, and extends each place to the longest match. A shard holds whole documents, so nothing is shuffled.

Words outside the benchmark's vocabulary can begin no match and are left out of the array. Test items travel
to the tasks in blocks of bounded size; with several blocks the documents pass through one block after another.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import free_name, release, shared, slices
from semcorpus.llm.words import ALPHANUMERIC, words

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
FOUND = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<begin:int,stop:int>>"


class Block(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; word number is place + 1
    numbers: np.ndarray  # word numbers of all items, 0 after each item
    begin: np.ndarray  # where each distinct query begins in `numbers`
    length: np.ndarray  # its words
    owners: list  # of each query: places in `names`
    names: list


def block_of(rows: list[tuple[str | None, str]], window: int) -> Block | None:
    """The items of one block, or None if no item has a word. An item without an id has windows and no name."""
    found = words(pa.array([t for _, t in rows], pa.string()), ALPHANUMERIC)
    if not len(found.hash):
        return None
    vocabulary, number = np.unique(found.hash, return_inverse=True)
    names = sorted({n for n, _ in rows if n is not None})
    place = {n: i for i, n in enumerate(names)}
    numbers, queries, at, k = [], {}, 0, 0
    for (name, _), count in zip(rows, found.counts):
        item = (number[k : k + count] + 1).astype(np.int32)
        k += count
        size = min(window, int(count))
        for i in range(int(count) - size + 1 if count else 0):
            owned = queries.setdefault(item[i : i + size].tobytes(), (at + i, size, set()))[2]
            if name is not None:
                owned.add(place[name])
        numbers.append(np.append(item, np.int32(0)))
        at += int(count) + 1
    begin, length, owners = zip(*queries.values())
    return Block(vocabulary, np.concatenate(numbers), np.array(begin), np.array(length), [sorted(o) for o in owners], names)


def packed(numbers: np.ndarray, bits: int, per: int) -> np.ndarray:
    """At every place, the next `per` numbers in one integer, first number highest."""
    n = len(numbers)
    wide = np.zeros(n + per, np.int64)
    wide[:n] = numbers
    out = np.zeros(n, np.int64)
    for i in range(per):
        out = (out << bits) | wide[i : i + n]
    return out


class Shard:
    """A suffix array over numbered words, ordered by the leading `depth` words."""

    def __init__(self, numbers: np.ndarray, vocabulary: int, depth: int):
        self.bits = max(1, int(vocabulary).bit_length())
        self.per = max(1, 62 // self.bits)
        self.levels = -(-depth // self.per)
        self.keys = np.concatenate([packed(numbers, self.bits, self.per), np.zeros(self.per * self.levels, np.int64)])
        at = np.flatnonzero(numbers)
        ranked = [self.keys[at + level * self.per] for level in reversed(range(self.levels))]
        self.order = at[np.lexsort(ranked)] if len(at) else at

    def ranges(self, numbers: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the range of suffixes that begin with its words: two binary searches."""
        low, high = [], []
        text = np.concatenate([numbers, np.zeros(self.per * self.levels, np.int32)]).astype(np.int64)
        top = (1 << self.bits) - 1
        for level in range(self.levels):
            a = np.zeros(len(begin), np.int64)
            b = a.copy()
            for i in range(self.per):
                j = level * self.per + i
                word = text[np.minimum(begin + j, len(text) - 1)]
                a = (a << self.bits) | np.where(j < length, word, 0)
                b = (b << self.bits) | np.where(j < length, word, top)
            low.append(a)
            high.append(b)
        return self._first(low, after=False), self._first(high, after=True)

    def _first(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        lo = np.zeros(len(wanted[0]), np.int64)
        hi = np.full(len(wanted[0]), len(self.order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            at = self.order[mid]
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for level, want in enumerate(wanted):
                have = self.keys[at + level * self.per]
                less |= equal & (have < want[open_])
                equal &= have == want[open_]
            right = less | equal if after else less
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, touching ones merged."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(texts: pa.Array, block: Block, window: int) -> tuple[np.ndarray, dict]:
    """Words of each text, and by text number: (longest match, names of items, spans of hit words)."""
    found = words(texts, ALPHANUMERIC)
    n = len(found.hash)
    if not n:
        return found.counts, {}
    slot = np.minimum(np.searchsorted(block.vocabulary, found.hash), len(block.vocabulary) - 1)
    number = np.where(block.vocabulary[slot] == found.hash, slot + 1, 0).astype(np.int32)
    doc = np.repeat(np.arange(len(texts)), found.counts)
    numbers = np.zeros(n + len(texts), np.int32)  # a 0 after each text
    numbers[np.arange(n) + doc] = number
    shard = Shard(numbers, len(block.vocabulary), int(block.length.max()))
    lo, hi = shard.ranges(block.numbers, block.begin, block.length)
    hits = hi - lo
    query = np.repeat(np.arange(len(hits)), hits)
    if not len(query):
        return found.counts, {}
    steps = np.arange(len(query)) - np.repeat(np.cumsum(hits) - hits, hits)
    at = shard.order[np.repeat(lo, hits) + steps]
    # How far each place agrees with the item beyond the window.
    size, wide, test = block.length[query].copy(), np.append(numbers, 0), np.append(block.numbers, 0)
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + size[live], block.begin[query[live]] + size[live]
        same = (wide[np.minimum(a, len(wide) - 1)] == test[np.minimum(b, len(test) - 1)]) & (test[np.minimum(b, len(test) - 1)] > 0)
        live = live[same]
        size[live] += 1
    first = np.cumsum(found.counts) - found.counts + np.arange(len(texts))  # slot of each text's first word
    owner = np.searchsorted(first, at, side="right") - 1
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length[query], -1)
    covered = np.cumsum(edge)[:-1] > 0
    out = {}
    sort = np.argsort(owner, kind="stable")
    heads = np.flatnonzero(np.diff(owner[sort], prepend=-1))
    for group in np.split(sort, heads[1:]):
        d = int(owner[group[0]])
        mine = covered[first[d] : first[d] + found.counts[d]].astype(np.int8)
        turn = np.diff(mine, prepend=0, append=0)
        spans = list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))
        names = {i for q in np.unique(query[group]).tolist() for i in block.owners[q]}
        out[d] = (int(size[group].max()), [block.names[i] for i in sorted(names)], spans)
    return found.counts, out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int):
    """The items, a block of bounded size at a time. Rows without a text are left out."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    part: list[tuple[str | None, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        part.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= block_bytes:
            yield block_of(part, window)
            part, size = [], 0
    if part:
        yield block_of(part, window)


def mark(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Every row of `df` with a struct of what it shares with the benchmark; returns the frame and the struct's name.

    The struct: `n_words`; `n_hit` words inside an occurrence of a window; `longest` verbatim match in words;
    `items` with occurring windows, sorted; `spans` of hit words. A window is `window` consecutive words of an
    item, or the whole of a shorter one. Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; repeated rows each get their own result. Words of an item without an id are hit like any other; it is not among
    `items`, as it has no name.
    """
    spark = df.sparkSession
    name = free_name(df, "_shared")
    place = df.columns.index(text_col)
    out = df.withColumn(name, F.lit(None).cast(f"struct<{_struct(FOUND)}>"))
    schema = out.schema
    tests = [b for b in (shared(spark, b) for b in blocks(benchmark, item_col, item_text, window, block_bytes) if b) if b]
    for step in tests or [None]:
        out = out.mapInArrow(_pass(step, place, window, schema[name].dataType), schema)
    return out, name


def _struct(ddl: str) -> str:
    head, _, rest = ddl.partition(", items")
    return ", ".join(f.replace(" ", ":") for f in head.split(", ")) + ", items:array<string>, spans:array<struct<begin:int,stop:int>>"


def _pass(step, place: int, window: int, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        block = step.value if step is not None else None
        keys = [f.name for f in arrow]
        for batch in batches:
            for lo, hi in slices(batch.column(place), SHARD_BYTES):
                rows, made = batch.slice(lo, hi - lo), []
                part, old = rows.column(place), rows.column(rows.num_columns - 1)
                counts, found = search(part, block, window) if block else (words(part, ALPHANUMERIC).counts, {})
                for i, count in enumerate(counts.tolist()):
                    longest, items, spans = found.get(i, (0, [], []))
                    if old[i].is_valid and (was := old[i].as_py())["n_hit"]:
                        longest, items = max(longest, was["longest"]), sorted({*items, *was["items"]})
                        spans = joined(spans + [(s["begin"], s["stop"]) for s in was["spans"]])
                    made.append((count, sum(b - a for a, b in spans), longest, items, [{"begin": a, "stop": b} for a, b in spans]))
                column = pa.array([dict(zip(keys, m)) for m in made], arrow)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], column], names=batch.schema.names)
        release()

    return run


def shared_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`id_col` and the fields of `mark` for every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, name = mark(narrow, benchmark, "text", **how)
    return found.select("doc_id", f"{name}.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that share no window with any item, with their own columns."""
    found, name = mark(docs, benchmark, text_col, **how)
    return found.where(F.col(f"{name}.n_hit") == 0).drop(name)
