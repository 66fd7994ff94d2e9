"""Word-first language identification with backoff to character n-grams.

A word seen in training scores by its log frequency in each language. An unseen word falls back, at each of its
characters, to the longest known n-gram that begins there, from `LONGEST` characters down to one. A text gets
the language with the largest sum over its words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.llm.batches import extend, free_name, shared, slices
from semcorpus.llm.components import cut, drop
from semcorpus.llm.words import mix

LONGEST = 4
UNKNOWN = "und"
# The classifier is fitted on about this many labelled texts in all, an equal share of each language and at least `LEAST_ROWS`
# of each, chosen by a hash of the id. It keeps every word and n-gram of them.
TRAINING_ROWS, LEAST_ROWS = 16_000, 200
# Bytes of text, and words, worked on at a time.
PORTION, WORDS = 1 << 18, 1 << 14
SMOOTHING = 0.1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


class Spelled(NamedTuple):
    """The letters of many texts with a 0 before and after every word."""

    code: np.ndarray
    begin: np.ndarray  # first letter of each word
    stop: np.ndarray  # the 0 after it
    hash: np.ndarray
    counts: np.ndarray  # words of each text


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def spelled(texts: pa.Array) -> Spelled:
    """Words are runs of letters of the lower-cased text."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(size)])
    kept = letters()[code]
    first, last = kept.copy(), kept.copy()
    edge = np.zeros(len(code) + 1, bool)
    edge[ends] = True
    first[1:] &= ~kept[:-1] | edge[1:-1]
    last[:-1] &= ~kept[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(a, ends))
    length = b - a
    # Lay the words out one after another, each with a 0 on both sides.
    stop = np.cumsum(length + 2) - 1
    begin = stop - length
    out = np.zeros(int(stop[-1]) + 1 if len(stop) else 0, np.uint32)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(begin, length) + step] = code[np.repeat(a, length) + step]
    # Polynomial hash of each word by running sums with inverse powers.
    n = len(out)
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _FACTOR, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(out.astype(np.uint64) + np.uint64(1)) * up[:n])])
    return Spelled(out, begin, stop, mix((total[stop] - total[begin]) * down[begin]), counts)


def grams(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place in `at` on."""
    h = np.full(len(at), n, np.uint64)
    for i in range(n):
        h = mix((h ^ code[at + i].astype(np.uint64)) * _FACTOR + np.uint64(1))
    return h


def places(words: Spelled, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams of the chosen words begin, counting the 0 on both sides, and the word each belongs to."""
    begin, stop = words.begin[which] - 1, words.stop[which] + 1
    count = np.maximum(stop - begin - n + 1, 0)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begin, count) + step, np.repeat(np.arange(len(which)), count)


class Counts(NamedTuple):
    """What is known of words, or of n-grams of one length: for each key a stretch of (language, score above that of a
    key the language lacks). The size follows the entries learned, not keys times languages."""

    keys: np.ndarray  # sorted hashes
    begin: np.ndarray  # of each key's stretch, and the end of the last
    lang: np.ndarray
    more: np.ndarray
    base: np.ndarray  # log score of a key that a language lacks


class Model(NamedTuple):
    languages: list[str]
    counts: list[Counts]  # words, then grams of 1, 2, ... characters
    floor: np.ndarray  # of a character never seen


def lookup(counts: Counts, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the keys, or -1."""
    if not len(counts.keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(counts.keys, hashes), len(counts.keys) - 1)
    return np.where(counts.keys[at] == hashes, at, -1)


def add(counts: Counts, row: np.ndarray, owner: np.ndarray, part: float, out: np.ndarray) -> None:
    """Add `part` of the scores of known keys to the rows of `out` that own them."""
    out += np.bincount(owner, minlength=len(out))[:, None] * (counts.base * part)
    size = counts.begin[row + 1] - counts.begin[row]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(counts.begin[row], size) + step
    flat = np.repeat(owner, size) * out.shape[1] + counts.lang[at]
    out += np.bincount(flat, counts.more[at] * part, out.size).reshape(out.shape)


def word_scores(model: Model, words: Spelled, which: np.ndarray) -> np.ndarray:
    """Log score of the chosen words in each language."""
    out = np.zeros((len(which), len(model.languages)))
    row = lookup(model.counts[0], words.hash[which])
    known = np.flatnonzero(row >= 0)
    add(model.counts[0], row[known], known, 1.0, out)
    lost = np.flatnonzero(row < 0)
    if not len(lost):
        return out
    at, owner = places(words, which[lost], 1)
    stop = words.stop[which[lost]] + 1
    for n in range(LONGEST, 0, -1):
        if not len(at):
            break
        fits = at + n <= stop[owner]
        row = np.full(len(at), -1)
        row[fits] = lookup(model.counts[n], grams(words.code, at[fits], n))
        hit = row >= 0
        # n overlapping grams cover each character n times.
        add(model.counts[n], row[hit], lost[owner[hit]], 1.0 / n, out)
        at, owner = at[~hit], owner[~hit]
    out += np.bincount(lost[owner], minlength=len(out))[:, None] * model.floor
    return out


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    words = spelled(texts)
    n, found = len(texts), [UNKNOWN] * len(texts)
    share = np.zeros(n)
    if not len(words.begin) or not model.languages:
        return found, share
    _, which, back = np.unique(words.hash, return_index=True, return_inverse=True)
    text = np.repeat(np.arange(n), words.counts)
    total, mean = np.zeros((n, len(model.languages))), np.zeros((n, len(model.languages)))
    # Words in the order of their keys, some at a time: only these are spread over all languages.
    order = np.argsort(back, kind="stable")
    ends = np.searchsorted(back[order], np.arange(0, len(which) + WORDS, WORDS))
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        scores = word_scores(model, words, which[k * WORDS : (k + 1) * WORDS])
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        own, at = back[order[a:b]] - k * WORDS, text[order[a:b]]
        for j in range(len(model.languages)):
            total[:, j] += np.bincount(at, scores[own, j], n)
            mean[:, j] += np.bincount(at, odds[own, j], n)
    some = np.flatnonzero(words.counts)
    best = total[some].argmax(axis=1)
    for i, j in zip(some.tolist(), best.tolist()):
        found[i] = model.languages[j]
    share[some] = np.minimum(1.0, mean[some, best] / words.counts[some])
    return found, share


def _counted(batches):
    """Per batch: how often each word and n-gram occurs in each language."""
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        rows: dict[str, list] = {k: [] for k in ("lang", "n", "gram", "c")}
        for lang in dict.fromkeys(langs):
            mine = texts.filter(pa.array([x == lang for x in langs]))
            for lo, hi in slices(mine, PORTION):
                words = spelled(mine.slice(lo, hi - lo))
                for n in range(LONGEST + 1):
                    every = np.arange(len(words.begin))
                    h = words.hash if n == 0 else grams(words.code, places(words, every, n)[0], n)
                    gram, c = np.unique(h, return_counts=True)
                    for key, value in (("lang", np.full(len(gram), lang, object)), ("n", np.full(len(gram), n, np.int32)), ("gram", gram.view(np.int64)), ("c", c.astype(np.int64))):
                        rows[key].append(value)
        if rows["n"]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows["lang"]), pa.string()), *[pa.array(np.concatenate(rows[k])) for k in ("n", "gram", "c")]],
                names=list(rows),
            )


def train(labelled: DataFrame, text_col: str, lang_col: str, key: Column, max_rows: int = TRAINING_ROWS, least_rows: int = LEAST_ROWS) -> Model:
    """Fit on about `max_rows` labelled rows: of each language an equal share (at least `least_rows`), chosen by a hash of
    `key`; a language with fewer takes part whole, and so does a row that repeats.

    Counts are summed in Spark; the driver gets every word and n-gram of those rows, once for each language that has it.
    Rows without a text or a language teach nothing. Without labelled rows the model knows no language.
    """
    have = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    pick = F.xxhash64(F.lit("training"), key)
    spark = labelled.sparkSession
    sizes = have.groupBy(lang_col).count().collect()
    each = max(least_rows, max_rows // max(1, len(sizes)))
    many = [(r[0], each / r[1]) for r in sizes if r[1] > each]
    if many:
        # A row for each language with more than its share.
        share = F.broadcast(spark.createDataFrame(many, "_many string, _share double"))
        place = F.pmod(pick, F.lit(1_000_000_000)) / 1_000_000_000
        have = have.join(share, F.col(lang_col) == F.col("_many"), "left").where(F.col("_share").isNull() | (place < F.col("_share")))
    parts = have.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(_counted, "lang string, n int, gram long, c long")
    languages = sorted(r[0] for r in sizes)
    named = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)]), F.col("lang")) if languages else F.lit(0)
    sums = cut(parts.groupBy(named.cast("int").alias("lang"), "n", "gram").agg(F.sum("c").alias("c")))
    counts = []
    for n in range(LONGEST + 1):
        got = sums.where(F.col("n") == n).select("lang", "gram", "c").toArrow()
        lang, gram, c = (got.column(k).to_numpy() for k in ("lang", "gram", "c"))
        order = np.lexsort((lang, gram.view(np.uint64)))
        lang, gram, c = lang[order], gram.view(np.uint64)[order], c[order]
        keys, begin = np.unique(gram, return_index=True)
        total = np.bincount(lang, c, len(languages)) + SMOOTHING * max(1, len(keys))
        base = np.log(SMOOTHING / total)
        more = np.log((c + SMOOTHING) / SMOOTHING)
        counts.append(Counts(keys, np.append(begin, len(gram)), lang.astype(np.int32), more.astype(np.float32), base))
    drop(sums)
    return Model(languages, counts, counts[1].base + np.log(SMOOTHING))


def mark(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """Every row with its predicted language and score; returns the frame and the names of the two columns.

    Null texts, texts without a letter and all texts under an untrained model get `und` and 0. The score is the
    mean over the words of the share that the predicted language has in the word. Repeated rows get equal results;
    of languages with equal sums the first by name wins.
    """
    lang, score = free_name(df, "_lang"), free_name(df, "_lang_score")
    sent = shared(df.sparkSession, model)

    def kernel(texts):
        found, share = predict(sent.value, texts)
        return [pa.array(found, pa.string()), pa.array(share)]

    return extend(df, text_col, [(lang, T.StringType()), (score, T.DoubleType())], kernel, PORTION), lang, score


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, lang, score = mark(narrow, model)
    return out.select("doc_id", F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def recognised(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents in a known language with a score of at least `least`, with their own columns."""
    out, lang, score = mark(docs, model, text_col)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
