"""Masked pseudo-likelihood of documents under a small bidirectional window network.

Every word is predicted from the words around it, on both sides, with itself left out. Words are hashed to `WORDS`
places; the network predicts a class of places of about equal mass, within a class the corpus frequencies of the
places decide, and within a place those of its words. The sum over a document of log P(word | words around) scores it.

Every distinct word of the corpus is counted in a table of Spark, which grows with the corpus. Words found often are
looked up in a table that every task holds, as a join on them would meet in a few tasks; all others are joined.

Training is data-parallel: each task walks its own documents with minibatches of gradient steps from common
weights, and a tree of partial sums averages the results, weighted by words. All documents take part in the
frequencies and in exactly one round. Only the network's weights have a fixed size, whatever the size of the corpus.

A network of fixed size can't remember texts. All contexts (two words on either side) are counted with the words that stood
in them, over the whole corpus; where a context also stands elsewhere, its words there, with the place itself left out, have
half a say in the chance of the word. Text that the corpus has twice scores far above text that it has
once; `recalled` is what this adds to the sum.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import shared, slices
from semcorpus.llm.components import cut
from semcorpus.llm.words import ALPHANUMERIC, ODD, Words, mix, words

# Parameters of the model: hashed words, classes, words on either side, width; 1.1 MB in all.
WORDS, CLASSES, SIDE, WIDTH = 1 << 14, 64, 2, 16
ROUNDS, BATCH, RATE, STRETCH = 2, 4096, 1.5, 30
# Results of tasks that are added up in one step.
FAN_IN = 6
# Words in the table that every task holds: the most frequent ones. Words that a task gathers before it passes counts on.
HELD, GATHERED = 1 << 17, 1 << 21
# Words whose contexts a task packs at a time; bytes of text whose words are a share, and bytes of shares looked at together.
PACKED, SHARE_BYTES, TOGETHER = 1 << 20, 1 << 21, 1 << 24
# Bytes of text that are hashed at a time, but in training; they fit a core's cache.
FINE = 1 << 17
# Documents are scored in so many parts, so that the contexts of one part at a time are on disk.
PARTS = 2
# What all words of a place that the corpus does not hold are counted as together.
UNSEEN = 0.5
# One context in so many is remembered: all of them. What a context's other occurrences say weighs so much.
CONTEXTS, TRUST = 1, 0.5
NONE = WORDS  # the place beyond the edge of a text
SPOTS = [-2, -1, 1, 2]


class Net(NamedTuple):
    embed: np.ndarray  # word places by width, one row more for the edge
    spot: np.ndarray  # weight of each neighbour's place by width
    inner: np.ndarray  # bias by width
    out: np.ndarray  # width by class
    outer: np.ndarray  # bias by class


class Frequencies(NamedTuple):
    of_class: np.ndarray  # class of each place
    within: np.ndarray  # log share of each place in its class
    mass: np.ndarray  # log count of each place, with the unseen words


def place_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(WORDS - 1)).astype(np.uint16)


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed place of every word, and the words of each text."""
    found = words(texts, ALPHANUMERIC)
    return place_of(found.hash), found.counts


def neighbours(place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places around each word, a row for each spot; edges of texts stand for what is beyond them."""
    n = len(place)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    stop = begin + np.repeat(counts, counts)
    out = np.full((len(SPOTS), n), NONE, np.uint16)
    here = np.arange(n)
    for row, spot in zip(out, SPOTS):
        at = here + spot
        ok = (at >= begin) & (at < stop)
        row[ok] = place[at[ok]]
    return out


def hidden(net: Net, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = net.embed.take(around, axis=0)
    return seen, _bent([s * w for s, w in zip(seen, net.spot)], net)


def _bent(parts: list[np.ndarray], net: Net) -> np.ndarray:
    total = parts[0]
    for part in parts[1:]:
        total += part
    total += net.inner
    return np.tanh(total, out=total)


def largest(z: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column; short rows are slow to go through one by one."""
    while z.shape[1] > 16 and z.shape[1] % 2 == 0:
        z = np.maximum(z[:, : z.shape[1] // 2], z[:, z.shape[1] // 2 :])
    return np.ascontiguousarray(z.T).max(axis=0)[:, None]


def class_masses(net: Net, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the chances of the classes are in proportion to, and its sum."""
    z = h @ net.out
    z += net.outer
    z -= largest(z)
    np.exp(z, out=z)
    return z, z.sum(axis=1, keepdims=True)


def class_chances(net: Net, h: np.ndarray) -> np.ndarray:
    z, total = class_masses(net, h)
    z /= total
    return z


def learn(net: Net, place: np.ndarray, around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step per minibatch, in place."""
    for lo in range(0, len(target), BATCH):
        part, want = around[:, lo : lo + BATCH], target[lo : lo + BATCH]
        n = len(want)
        seen, h = hidden(net, part)
        g = class_chances(net, h)
        g[np.arange(n), want] -= 1
        g *= np.float32(rate / n)
        back = (g @ net.out.T) * (1 - h * h)
        grad = (back * net.spot[:, None, :]).reshape(-1, WIDTH)
        net.spot[:] -= (back * seen).sum(axis=1)
        # Gradients of one place next to each other, summed; words seen often in a batch move further.
        flat_ = part.ravel()
        order = np.argsort(flat_, kind="stable")
        sorted_ = flat_[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        net.embed[sorted_[first]] -= np.float32(STRETCH) * np.add.reduceat(grad.take(order, axis=0), first, axis=0)
        net.out[:] -= h.T @ g
        net.outer[:] -= g.sum(axis=0)
        net.inner[:] -= back.sum(axis=0)


def fresh() -> Net:
    rng = np.random.default_rng(3)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    return Net(draw(WORDS + 1, WIDTH), np.ones((len(SPOTS), WIDTH), np.float32) + draw(len(SPOTS), WIDTH), np.zeros(WIDTH, np.float32), draw(WIDTH, CLASSES), np.zeros(CLASSES, np.float32))


def flat(net: Net) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net])


def shaped(values: np.ndarray) -> Net:
    out, at = [], 0
    for p in fresh():
        out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Net(*out)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each distinct word of the table occurs, by its 64-bit hash, written to the shared folder."""

    def passed(held):
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(0), FINE):
                held.append(words(batch.column(0).slice(lo, hi - lo), ALPHANUMERIC).hash)
                size += len(held[-1])
                if size > GATHERED:
                    yield passed(held)
                    held, size = [], 0
        if size:
            yield passed(held)

    return cut(docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequencies(counts: DataFrame) -> Frequencies:
    """How often the words of each place occur in the whole corpus; at most `WORDS` sums reach the driver."""
    place = F.col("word").bitwiseAND(WORDS - 1).cast("int")
    got = counts.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).toArrow()
    total = np.full(WORDS, UNSEEN)
    total[got.column("place").to_numpy()] += got.column("n").to_numpy()
    # Frequent places first; a class ends where it has its share of the mass.
    order = np.lexsort((np.arange(WORDS), -total))
    mass = np.cumsum(total[order]) - total[order] / 2
    of_class = np.empty(WORDS, np.int64)
    of_class[order] = np.minimum(CLASSES - 1, (mass * CLASSES / total.sum()).astype(np.int64))
    share = np.log(total / np.bincount(of_class, total, CLASSES)[of_class])
    return Frequencies(of_class, share.astype(np.float32), np.log(total))


def remembered(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words whose context is remembered: their numbers, the hash of the context, and the word place."""
    n, context = len(found.hash), np.zeros(len(found.hash), np.uint64)
    begin = np.repeat(np.cumsum(found.counts) - found.counts, found.counts)
    stop = begin + np.repeat(found.counts, found.counts)
    for spot in SPOTS:
        at = np.arange(n) + spot
        ok = (at >= begin) & (at < stop)
        near = np.zeros(n, np.uint64)
        near[ok] = found.hash[at[ok]]
        context = mix(context * ODD + near + np.uint64(1))
    some = np.flatnonzero((context >> np.uint64(40)) % np.uint64(CONTEXTS) == 0)
    return some, context[some], place_of(found.hash[some])


def spot_key(context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hash of a context and the place of a word that stands in it."""
    return mix(context * ODD + place.astype(np.uint64) + np.uint64(1))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it a run of equal ones begins."""
    order = np.argsort(key)
    sorted_ = key[order]
    return order, np.flatnonzero(np.concatenate([[len(key) > 0], sorted_[1:] != sorted_[:-1]])[: len(key)])


def shares_of(docs: DataFrame, text_col: str = "text") -> int:
    """In how many shares the words of a table are dealt, so that the size of a share does not grow with it."""
    return 1 + (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // SHARE_BYTES


def cells(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of the values, a cell from each beginning to the next."""
    ends = (np.append(begin, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def packed(shares: int, key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """The shares that have some of the keys, the first of each by its number in the columns, and keys and columns as bytes."""
    of = ((key >> np.uint64(32)) % np.uint64(shares)).astype(np.uint16 if shares <= 1 << 16 else np.int64)
    order = np.argsort(of, kind="stable")
    begin = np.flatnonzero(np.diff(of[order].astype(np.int64), prepend=-1))
    return of[order[begin]].astype(np.int32), order, [cells(c[order], begin) for c in (key, *columns)]


def counted(shares: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Contexts and word places, each pair once with its count, packed in shares. Nothing depends on their order in a share: equal
    counts and places lie together, so that less is shuffled.
    """
    context, place = (np.concatenate(h) for h in zip(*held))
    order, begin = runs(spot_key(context, place))
    first, n = order[begin], np.diff(begin, append=len(order)).astype(np.uint32)
    del order, begin
    # Short numbers are quick to sort; counts beyond their limit stay in any order.
    alike = np.lexsort((place[first], np.minimum(n, 0xFFFF).astype(np.uint16)))
    first, n = first[alike], n[alike]
    del alike
    share, _, found = packed(shares, context[first], place[first], n)
    return pa.RecordBatch.from_arrays([pa.array(share), *found], names=["share", "context", "place", "n"])


def unpacked(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The values of a column of bytes end to end."""
    parts = []
    for chunk in table.column(name).chunks:
        if len(chunk) and chunk.null_count < len(chunk):
            _, offsets, data = chunk.buffers()
            ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if ends[-1] > ends[0]:
                parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return np.frombuffer(np.concatenate(parts), kind) if parts else np.zeros(0, kind)


def whole_shares(batches):
    """Rows sorted by share, as tables of one share or of several small ones."""
    held, size, last = [], 0, None
    for batch in batches:
        share = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.diff(share, prepend=share[:1] - 1))
        for lo, hi in zip(begin, [*begin[1:], len(share)]):
            if size > TOGETHER and share[lo] != last:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size, last = size + held[-1].nbytes, share[lo]
    if held:
        yield pa.Table.from_batches(held)


def filled(types: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
    """Rows with null in the columns that are not given."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(size, t) for k, t in types.items()], names=list(types))


def settled(df: DataFrame) -> DataFrame:
    """The rows as `cut` keeps them; what was shuffled for them is deleted as soon as they are written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def contexts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, p, n) of every remembered context that the corpus has more than once, written to the shared folder: by the hash of
    context and word place, the share of that place in the context's other occurrences, and how often it stands there."""
    shares = shares_of(docs, text_col)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(0), FINE):
                held.append(remembered(words(batch.column(0).slice(lo, hi - lo), ALPHANUMERIC))[1:])
                size += len(held[-1][0])
                if size > PACKED:
                    yield counted(shares, held)
                    held, size = [], 0
        if size:
            yield counted(shares, held)

    def add(batches):
        for table in whole_shares(batches):
            context, place, n = unpacked(table, "context", np.uint64), unpacked(table, "place", np.uint16), unpacked(table, "n", np.uint32)
            order, begin = runs(context)
            n = n[order].astype(np.int64)
            total = np.repeat(np.add.reduceat(n, begin), np.diff(begin, append=len(n)))
            again = np.flatnonzero(total > 1)
            if not len(again):
                continue
            key = spot_key(context[order[again]], place[order[again]])
            spot, begin = runs(key)
            here, first = np.add.reduceat(n[again[spot]], begin), spot[begin]
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array((here - 1) / (total[again[first]] - 1)), pa.array(here)], names=["word", "p", "n"])

    # Dealt by the context once: counts by place and by context are then made where the rows are.
    dealt = docs.select(text_col).mapInArrow(count, "share int, context binary, place binary, n binary").repartition("share").sortWithinPartitions("share")
    return settled(dealt.mapInArrow(add, "word long, p double, n long"))


def _plus(a: tuple, b: tuple) -> tuple:
    """Sums of weights and words, in double precision; None weighs nothing."""
    return b if a[0] is None else a if b[0] is None else (np.add(a[0], b[0], dtype=np.float64), a[1] + b[1])


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[Net, Frequencies]:
    """Fit on every document: each belongs to one round by a hash of its text. An empty corpus leaves the network as drawn.

    `counts` are the corpus's `word_counts`, if they are at hand.
    """
    spark = docs.sparkSession
    known = frequencies(word_counts(docs, text_col) if counts is None else counts)
    sent, net = shared(spark, known), fresh()
    for turn in range(rounds):
        given = shared(spark, net)

        def walk(batches):
            mine, seen, step = Net(*(p.copy() for p in given.value)), 0, 0
            for batch in batches:
                texts = batch.column(0)
                for lo, hi in slices(texts):
                    place, counts = places(texts.slice(lo, hi - lo))
                    learn(mine, place, neighbours(place, counts), sent.value.of_class[place], RATE / (1 + turn))
                    seen += len(place)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(flat(mine) * np.float32(seen)).tobytes()], pa.binary()), pa.array([float(seen)])], names=["weights", "seen"])

        due = docs.where(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == turn) if rounds > 1 else docs
        sums = due.select(text_col).mapInArrow(walk, "weights binary, seen double").rdd
        # What a task has learned travels as it is; only sums need double precision.
        pairs = sums.map(lambda r: (np.frombuffer(r["weights"], np.float32), r["seen"]))
        # Deep enough that a handful of sums reach the driver, however many tasks there were.
        depth = max(2, ceil(log(max(2, pairs.getNumPartitions()), FAN_IN)))
        total, seen = pairs.treeAggregate((None, 0.0), _plus, _plus, depth)
        if seen:
            net = shaped(total.astype(np.float64) / seen)
        given.unpersist()
    return net, known


def word_logs(net: Net, known: Frequencies, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log P(word | words around) of every word."""
    out, around, want = np.empty(len(place)), neighbours(place, counts), known.of_class[place]
    tables = [net.embed * w for w in net.spot]
    for lo in range(0, len(place), BATCH):
        part = slice(lo, lo + BATCH)
        mass, total = class_masses(net, _bent([t.take(a, axis=0) for t, a in zip(tables, around[:, part])], net))
        out[part] = np.log(np.maximum(mass[np.arange(len(mass)), want[part]] / total[:, 0], 1e-30))
    return out + known.within[place]


def _logs(net: Net, known: Frequencies, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The log chance of the place of each word, and their sum for each text."""
    total, some = np.zeros(len(found.counts)), found.counts > 0
    if not some.any():
        return np.zeros(0), total
    logs = word_logs(net, known, place_of(found.hash), found.counts)
    total[some] = np.add.reduceat(logs, (np.cumsum(found.counts) - found.counts)[some])
    return logs, total


def often(counts: DataFrame, held: int) -> tuple[np.ndarray, pa.Table, DataFrame]:
    """Sorted hashes of the most frequent words, at most `held`, with their rows; and the table of all others."""
    # Sixteen steps to each doubling; whole steps from the top, as many as there is room for.
    step = F.floor(F.log2("n") * 16)
    least, room = 1 << 30, held
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = counts.where(step >= least).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], top.take(order), counts.where(step < least)


def among(word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted words, and whether it does."""
    at, has = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    if len(word) and len(key):
        # Most keys are told off by a few of their bits.
        spread = np.uint64(max(1, 60 - len(word).bit_length()))
        some = np.zeros(1 << (64 - int(spread)), bool)
        some[word >> spread] = True
        tried = np.flatnonzero(some[key >> spread])
        found = np.searchsorted(word, key[tried])
        found[found == len(word)] = 0
        at[tried], has[tried] = found, word[found] == key[tried]
    return at, has


def gain(p: np.ndarray, place_log: np.ndarray) -> np.ndarray:
    """What a context's other occurrences add to the log chance of a place that the network has given."""
    return np.log((1 - TRUST) + TRUST * p * np.exp(-place_log.astype(np.float64)))


# Rows that are dealt together: documents, their words and contexts, and what is told of words and contexts.
DOCUMENT, WORD, CONTEXT, WORD_TOLD, CONTEXT_TOLD = range(5)


def _told(table: DataFrame, shares: int, kind: int) -> DataFrame:
    """The values of words, packed in shares."""
    def passed(held):
        key, value = (np.concatenate(h) for h in zip(*held))
        share, _, found = packed(shares, key, value)
        return pa.RecordBatch.from_arrays([pa.array(share), pa.array(np.full(len(share), kind, np.int32)), *found], names=["share", "kind", "key", "value"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > PACKED:
                yield passed(held)
                held, size = [], 0
        if size:
            yield passed(held)

    return table.mapInArrow(run, "share int, kind int, key binary, value binary")


def scored(docs: DataFrame, net: Net, known: Frequencies, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None, held: int = HELD, memory: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over the words) and mean_log of every document; with `counts` also `recalled`,
    the part of the sum that the remembered contexts add (`memory`, the corpus's `contexts`; 0 without it).

    `counts` are the `word_counts` that `known` was made from: they tell the words of a place apart, and words that the
    corpus does not hold share `UNSEEN` in their place. Without them the score is that of the places. Null texts and texts
    without words have 0 words, a sum of 0 and a null mean. Repeated rows get equal results but for rounding in single precision.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    if counts is None:
        sent = shared(docs.sparkSession, (net, known))

        def run(batches):
            for batch in batches:
                for lo, hi in slices(batch.column(1)):
                    found = words(batch.column(1).slice(lo, hi - lo), ALPHANUMERIC)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found.counts.astype(np.int64)), pa.array(_logs(*sent.value, found)[1])], names=["doc_id", "n_words", "log_likelihood"])

        sums = narrow.mapInArrow(run, f"doc_id {kind}, n_words long, log_likelihood double")
    else:
        word, top, rest = often(counts, held)
        log_n, told = np.log(top.column("n").to_numpy()), [(WORD_TOLD, rest.select("word", F.log("n")))]
        # Contexts found often are looked up in a table that every task holds, as words are.
        spot, share_of_spot = np.zeros(0, np.uint64), np.zeros(0)
        if memory is not None:
            spot, top, rest = often(memory, held)
            share_of_spot, told = top.column("p").to_numpy(), [*told, (CONTEXT_TOLD, rest.select("word", "p"))]
        sent = shared(docs.sparkSession, (net, known, word, log_n, spot, share_of_spot))
        parts = PARTS if memory is not None else 1
        shares = 1 + shares_of(narrow) // parts
        found = [_sums(narrow.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part), kind, sent, told, shares, memory is not None) for part in range(parts)]
        # A part after the other: the contexts of a part are deleted before the next part's are dealt.
        sums = reduce(DataFrame.union, [settled(f) for f in found])
    return sums.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def _sums(docs: DataFrame, id_type: str, sent: Broadcast, told: list[tuple[int, DataFrame]], shares: int, recall: bool) -> DataFrame:
    """doc_id, n_words, log_likelihood and recalled of documents. Words and contexts that tasks don't hold are dealt by their hash, and so is what is `told` of them."""
    schema = f"share int, kind int, block long, row long, doc_id {id_type}, n_words long, own double, recalled double, key binary, at binary, value binary"
    added = {"block": pa.int64(), "row": pa.int64(), "doc_id": pa.null(), "n_words": pa.int64(), "own": pa.float64(), "recalled": pa.float64(), "at": pa.binary(), "owns": pa.binary(), "recalls": pa.binary()}
    types = {"share": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "row": pa.int64(), "doc_id": pa.null(), "n_words": pa.int64(), "own": pa.float64(), "recalled": pa.float64(), "key": pa.binary(), "at": pa.binary(), "value": pa.binary()}

    def passed(kind, first, held):
        """Of words or contexts: the first of their rows, how far each is from the one before, and a value."""
        row, key, value = (np.concatenate(h) for h in zip(*held))
        share, order, (keys, values) = packed(shares, key, value)
        at = (row - first)[order]
        step = np.diff(at, prepend=0)
        begin = np.frombuffer(keys.buffers()[1], np.int32)[:-1] // 8
        step[begin] = 0
        return filled(types, share=pa.array(share), kind=pa.array(np.full(len(share), kind, np.int32)), block=pa.array(np.full(len(share), first)), row=pa.array(at[begin] + first), key=keys, at=cells(step.astype(np.int32), begin), value=values)

    # What is found: documents, and what words and contexts add to those of a block.
    FOUND = ["block", "row", "doc_id", "n_words", "own", "recalled"]

    def rows(batches):
        """A row for each document with all but what is dealt, and rows for the words and contexts that are."""
        number = TaskContext.get().partitionId() << 40
        net, known, word, log_n, spot, share_of_spot = sent.value
        first, held, size = number, {WORD: [], CONTEXT: []}, 0
        for batch in batches:
            types["doc_id"] = batch.column(0).type
            for lo, hi in slices(batch.column(1), FINE):
                found, n = words(batch.column(1).slice(lo, hi - lo), ALPHANUMERIC), hi - lo
                (logs, total), owner = _logs(net, known, found), np.repeat(np.arange(n), found.counts)
                seen, back = np.unique(found.hash, return_inverse=True)
                at, has = among(word, seen)
                add = -known.mass[place_of(seen)]
                add[has] += log_n[at[has]]
                total += np.bincount(owner, add[back], n)
                lost = ~has[back]
                pairs, times = np.unique(owner[lost] * len(seen) + back[lost], return_counts=True)
                ids = number + np.arange(n)
                number += n
                held[WORD].append((ids[pairs // max(1, len(seen))], seen[pairs % max(1, len(seen))], times.astype(np.float32)))
                recalled = np.zeros(n)
                if recall:
                    some, *context = remembered(found)
                    key, log_ = spot_key(*context), logs[some].astype(np.float32)
                    at, has = among(spot, key)
                    recalled += np.bincount(owner[some[has]], gain(share_of_spot[at[has]], log_[has]), n)
                    held[CONTEXT].append((ids[owner[some[~has]]], key[~has], log_[~has]))
                yield filled(
                    types,
                    share=pa.array((mix(ids.astype(np.uint64)) % np.uint64(shares)).astype(np.int32)),
                    kind=pa.array(np.full(n, DOCUMENT, np.int32)),
                    block=pa.array(np.full(n, first)),
                    row=pa.array(ids),
                    doc_id=batch.column(0).slice(lo, n),
                    n_words=pa.array(found.counts.astype(np.int64)),
                    own=pa.array(total),
                    recalled=pa.array(recalled),
                )
                size += len(found.hash)
                if size > PACKED:
                    yield from (passed(k, first, h) for k, h in held.items() if sum(len(x[0]) for x in h))
                    first, held, size = number, {WORD: [], CONTEXT: []}, 0
        yield from (passed(k, first, h) for k, h in held.items() if sum(len(x[0]) for x in h))

    def look(batches):
        """Documents as they are, and for each row of words or contexts what they add to its documents."""
        for table in whole_shares(batches):
            added["doc_id"], kind = table.schema.field("doc_id").type, table.column("kind").to_numpy()
            of = lambda k: table.filter(pa.array(kind == k))
            alone = of(DOCUMENT)
            if alone.num_rows:
                yield from (filled(added, **{k: b.column(k) for k in FOUND}) for b in alone.to_batches())
            for asked, telling, name in ((WORD, WORD_TOLD, "owns"), (CONTEXT, CONTEXT_TOLD, "recalls")):
                some, known = of(asked), of(telling)
                if not some.num_rows:
                    continue
                key, value = unpacked(some, "key", np.uint64), unpacked(some, "value", np.float32)
                size = pc.binary_length(some.column("key")).to_numpy() // 8
                owner, far = np.repeat(np.arange(len(size)), size), np.cumsum(unpacked(some, "at", np.int32).astype(np.int64))
                block, begin = some.column("block").to_numpy(), np.cumsum(size) - size
                at = far + np.repeat(some.column("row").to_numpy() - block - far[begin], size)
                word, says = unpacked(known, "key", np.uint64), unpacked(known, "value", np.float64)
                order = np.argsort(word)
                there, has = among(word[order], key)
                if asked == WORD:
                    # Words that the corpus does not hold share what is unseen.
                    more = np.full(len(key), log(UNSEEN))
                    more[has] = says[order[there[has]]]
                    more *= value
                else:
                    # A context that stands nowhere else says nothing.
                    more, owner, at = gain(says[order[there[has]]], value[has]), owner[has], at[has]
                if len(more):
                    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
                    owner, at, more = owner[first], at[first], np.add.reduceat(more, first)
                    begin = np.flatnonzero(np.diff(owner, prepend=-1))
                    yield filled(added, block=pa.array(block[owner[begin]]), at=cells(at.astype(np.int32), begin), **{name: cells(more, begin)})

    def total(batches):
        for table in whole_shares(batches):
            docs = table.filter(pc.is_valid(table.column("row"))).combine_chunks()
            rest = table.filter(pc.is_null(table.column("row")))
            rows = docs.column("row").to_numpy()
            order = np.argsort(rows)
            sums = {k: docs.column(k).to_numpy().copy() for k in ("own", "recalled")}
            for name, sum_ in zip(("owns", "recalls"), sums.values()):
                some = rest.filter(pc.is_valid(rest.column(name)))
                if some.num_rows:
                    size = pc.binary_length(some.column("at")).to_numpy() // 4
                    row = unpacked(some, "at", np.int32) + np.repeat(some.column("block").to_numpy(), size)
                    sum_ += np.bincount(order[np.searchsorted(rows, row, sorter=order)], unpacked(some, name, np.float64), len(rows))
            if len(rows):
                for b in docs.select(["doc_id", "n_words"]).to_batches():
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums["own"] + sums["recalled"]), pa.array(sums["recalled"])], names=["doc_id", "n_words", "log_likelihood", "recalled"])

    dealt = docs.mapInArrow(rows, schema)
    for kind, table in told:
        dealt = dealt.unionByName(_told(table, shares, kind), allowMissingColumns=True)
    parts = dealt.repartition("share").sortWithinPartitions("share").mapInArrow(look, f"block long, row long, doc_id {id_type}, n_words long, own double, recalled double, at binary, owns binary, recalls binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(total, f"doc_id {id_type}, n_words long, log_likelihood double, recalled double")
