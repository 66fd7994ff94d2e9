"""Toxic texts by multiple-instance learning.

Only whole documents carry a label. Each sentence gets a probability from a logistic model over its hashed words
and their beginnings, and a document is toxic unless all of its sentences are not: 1 - product(1 - p), a noisy-or. The gradient of that
score trains the sentence model from document labels, so afterwards the sentences at fault can be pointed out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.llm.batches import extend, free_name, shared, slices, utf8
from semcorpus.llm.words import ALPHANUMERIC, mix, words

# Places for hashed words; a model takes 4 bytes for each in every task.
PLACES = 1 << 20
# Besides whole words, their first 4, 5 and 6 bytes: inflected and compound forms share them.
HEADS = (4, 5, 6)
KINDS = ("word", *[f"head_{k}" for k in HEADS])
# The classifier is fitted on about this many labelled texts of either class, chosen by a hash of the id, and on
# about this many characters of them in all, whichever is reached first.
TRAINING_ROWS, TRAINING_CHARS = 4_000, 16_000_000
EPOCHS, BATCH, RATE, SHRINK, MOST, LEAST_DOCS = 20, 32, 20.0, 0.25, 12.0, 3
START = -5.0
# Least G statistic of a telling word; 15 happens by chance about once in 10,000 words.
LEAST_G = 15.0
# A sentence at or above it is reported.
SENTENCE = 0.2

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


class Bags(NamedTuple):
    """Sentences that have words, document by document."""

    place: np.ndarray  # hashed word and beginnings, a row for each kind; 0 for none
    first: np.ndarray  # first word of each sentence
    counts: np.ndarray  # sentences of each text
    begin: np.ndarray  # code points within the text
    stop: np.ndarray


class Model(NamedTuple):
    weights: np.ndarray
    bias: float  # log odds of a sentence before its telling words
    leak: float  # log odds of a toxic label without a toxic sentence


def bags(texts: pa.Array) -> Bags:
    found = words(texts, ALPHANUMERIC)
    n = len(found.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return Bags(np.zeros((1 + len(HEADS), 0), np.int32), none, np.zeros(len(texts), np.int64), none, none)
    place = np.stack([(h & np.uint64(PLACES - 1)).astype(np.int32) for h in (found.hash, *map(found.heads, HEADS))])
    doc = np.repeat(np.arange(len(texts)), found.counts)
    number = np.cumsum(_ENDS[found.raw])[found.start]
    new = np.ones(n, bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    points = np.concatenate([[0], np.cumsum((found.raw & 0xC0) != 0x80)])
    size = np.bincount(doc[first], minlength=len(texts))
    zero = points[utf8(texts)[1][:-1]][doc[first]]
    return Bags(place, first, size, points[found.start[first]] - zero, points[found.end[last]] - zero)


def sentence_odds(model: Model, b: Bags) -> np.ndarray:
    """Log odds of each sentence: the bias and the weight of each distinct telling word. Without any it cannot be toxic."""
    z = np.full(len(b.first), -np.inf)
    if len(b.first):
        line = np.cumsum(np.bincount(b.first, minlength=b.place.shape[1])) - 1
        kind, told = np.nonzero(model.weights[b.place])
        pairs = np.unique(line[told] * PLACES + b.place[kind, told])
        z[pairs // PLACES] = model.bias
        np.add.at(z, pairs // PLACES, model.weights[pairs % PLACES])
    return z


def noisy_or(z: np.ndarray, counts: np.ndarray, leak: float) -> np.ndarray:
    """1 - product of the chances that neither the leak nor any sentence is toxic."""
    total = np.full(len(counts), np.logaddexp(0, leak))
    some = counts > 0
    if some.any():
        total[some] += np.add.reduceat(np.logaddexp(0, z), (np.cumsum(counts) - counts)[some])
    return -np.expm1(-total)


def telling(docs: np.ndarray, places: np.ndarray, words_: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which places toxic documents hold clearly more often: a G test over documents.

    Words that stand between the same two words in most toxic documents belong to a copied passage, not to a
    vocabulary, and are left out.
    """
    n = np.array([(label == 0).sum(), (label == 1).sum()], float)
    pairs = np.unique(docs * PLACES + places)
    with_ = np.stack([np.bincount(pairs[label[pairs // PLACES] == y] % PLACES, minlength=PLACES) for y in (0, 1)]).astype(float)
    rate = with_.sum(axis=0) / n.sum()
    g = np.zeros(PLACES)
    for y in (0, 1):
        for seen, chance in ((with_[y], rate), (n[y] - with_[y], 1 - rate)):
            g += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(n[y] * chance, 1e-9))
    around = mix(np.append(0, words_[:-1]).astype(np.uint64) * np.uint64(PLACES) + np.append(words_[1:], 0).astype(np.uint64))
    toxic = np.flatnonzero(label[docs] == 1)
    _, one = np.unique(mix(around[toxic] + places[toxic].astype(np.uint64)), return_index=True)
    contexts = np.bincount(places[toxic[one]], minlength=PLACES)
    out = (g >= LEAST_G) & (with_[1] > n[1] * rate) & (with_[1] >= LEAST_DOCS) & (contexts >= 0.5 * with_[1])
    out[0] = False
    return out


def fit(place: np.ndarray, sizes: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient steps over batches of documents. `sizes`: words of each sentence; `counts`: sentences of each document.

    Words that the labels do not tell apart get no weight. Steps are not scaled by word, so frequent words learn first
    and explain their documents; what then has nothing left to explain shrinks to zero after each round. The leak is
    the chance of a toxic label without a toxic sentence and takes up wrong labels.
    """
    line = np.repeat(np.arange(len(sizes)), sizes)
    doc_of_line = np.repeat(np.arange(len(counts)), counts)
    owner, found = doc_of_line[line], []
    for kind in place:
        kept = np.flatnonzero(telling(owner, kind, place[0], label)[kind])
        found.append(line[kept] * PLACES + kind[kept])
    pairs = np.unique(np.concatenate(found))
    line, place = pairs // PLACES, pairs % PLACES
    # Sentences without such a word have no say.
    used, line = np.unique(line, return_inverse=True)
    owner = doc_of_line[used]
    line_at = np.searchsorted(owner, np.arange(len(counts) + 1))
    word_at = np.searchsorted(line, np.arange(len(used) + 1))
    weights, leak, seen_leak = np.zeros(PLACES), -4.0, 1e-6
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(counts))
        for lo in range(0, len(order), BATCH):
            docs = np.sort(order[lo : lo + BATCH])
            lines = np.concatenate([np.arange(line_at[d], line_at[d + 1]) for d in docs])
            at = np.concatenate([place[word_at[line_at[d]] : word_at[line_at[d + 1]]] for d in docs])
            size = word_at[lines + 1] - word_at[lines]
            z = np.bincount(np.repeat(np.arange(len(lines)), size), weights[at], len(lines)) + START
            mine = np.repeat(np.arange(len(docs)), line_at[docs + 1] - line_at[docs])
            total = np.bincount(mine, np.logaddexp(0, z), len(docs)) + np.logaddexp(0, leak)
            slope = np.where(label[docs] == 1, -1 / np.expm1(np.clip(total, 1e-3, 50)), 1.0) * weight[docs]
            g = slope[mine] / (1 + np.exp(-z))
            u, back = np.unique(at, return_inverse=True)
            step = RATE / len(docs) * np.bincount(back, np.repeat(g, size), len(u))
            weights[u] = np.clip(weights[u] - step, 0, MOST)
            down = slope.sum() / len(docs) / (1 + np.exp(-leak))
            seen_leak += down * down
            leak -= 0.2 * down / np.sqrt(seen_leak)
        weights = np.maximum(0, weights - SHRINK)
    return Model(weights.astype(np.float32), START, float(leak))


def _bagged(batches):
    for batch in batches:
        for lo, hi in slices(batch.column(0)):
            b = bags(batch.column(0).slice(lo, hi - lo))
            size = np.diff(np.append(b.first, b.place.shape[1]))
            line = np.concatenate([[0], np.cumsum(b.counts)])
            word = np.concatenate([[0], np.cumsum(size)])
            n = range(hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(lo, hi - lo),
                    pa.array([size[line[i] : line[i + 1]].astype(np.int32) for i in n], pa.list_(pa.int32())),
                    *[pa.array([kind[word[line[i]] : word[line[i + 1]]] for i in n], pa.list_(pa.int32())) for kind in b.place],
                ],
                names=["y", "sizes", *KINDS],
            )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAINING_ROWS, max_chars: int = TRAINING_CHARS) -> Model:
    """Fit on about `max_rows` labelled documents of either class; the driver gets their hashed words.

    An id with several labels counts as toxic if one says so. Without documents of both classes every text scores near 0.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    size = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    if not {0, 1} <= set(size):
        return Model(np.zeros(PLACES, np.float32), START, START)
    place = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1_000_000)) / 1_000_000
    share = {y: min(1.0, max_rows / n) for y, n in size.items()}
    # At most about 2 * max_rows ids and labels travel to the tasks.
    picked = given.withColumn("place", place / F.when(F.col("y") == 1, share[1]).otherwise(share.get(0, 1.0))).where("place < 1")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    found = texts.join(F.broadcast(picked), "id")
    chars = found.agg(F.sum(F.length("text"))).first()[0] or 0
    part = min(1.0, max_chars / max(1, chars))
    got = found.where(F.col("place") < part).select("text", F.col("y").cast("int").alias("y")).mapInArrow(_bagged, ", ".join(["y int", *[f"{k} array<int>" for k in ("sizes", *KINDS)]])).toArrow().combine_chunks()
    label = got.column("y").to_numpy()
    if not {0, 1} <= set(label.tolist()):
        return Model(np.zeros(PLACES, np.float32), START, START)
    sizes, *kinds = (pc.list_flatten(got.column(k)).to_numpy() for k in ("sizes", *KINDS))
    counts = pc.list_value_length(got.column("sizes")).to_numpy()
    weight = np.where(label == 1, 1 / share[1], 1 / share.get(0, 1.0))
    return fit(np.stack(kinds), sizes, counts, label, weight / weight.mean())


def mark(df: DataFrame, model: Model, text_col: str = "text", least: float = SENTENCE) -> tuple[DataFrame, str, str]:
    """Every row with its score and the sentences at or above `least`; returns the frame and the two names.

    A sentence: begin and stop in code points of the text, and its own score. Null texts and texts without words
    have none and score the leak. Repeated rows get equal results.
    """
    score, lines = free_name(df, "_toxic"), free_name(df, "_toxic_sentences")
    sent = shared(df.sparkSession, model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def kernel(texts):
        b = bags(texts)
        z = sentence_odds(sent.value, b)
        p = 1 / (1 + np.exp(-z))
        found: list[list] = [[] for _ in range(len(texts))]
        owner = np.repeat(np.arange(len(texts)), b.counts)
        for i in np.flatnonzero(p >= least).tolist():
            found[owner[i]].append({"begin": int(b.begin[i]), "stop": int(b.stop[i]), "score": float(p[i])})
        return [pa.array(noisy_or(z, b.counts, sent.value.leak)), pa.array(found, kind)]

    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType())])
    return extend(df, text_col, [(score, T.DoubleType()), (lines, T.ArrayType(span))], kernel), score, lines


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = SENTENCE) -> DataFrame:
    """doc_id, score and `sentences` at fault of every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, score, lines = mark(narrow, model, least=least)
    return out.select("doc_id", F.col(score).alias("score"), F.col(lines).alias("sentences"))
