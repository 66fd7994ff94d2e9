"""Phrases whose words occur together, from a weighted de Bruijn graph of the corpus.

Every word starts one edge: the run of four words from there, shorter where its piece ends. Edges lead from one node (the
first three words) to the next (the last three); equal edges are one, with the number of times as weight. The count of a
node is its outflow: all edges that leave it, plus the edges that end with it because its piece ends there. In the same
way pairs are summed from nodes. Counts of words come from a pass of their own, which also tells which words are too rare
for any candidate: a run ends before such a word, as no candidate can hold it.

Edges between the 65,534 most frequent words of a language are 64-bit numbers; others are four 63-bit hashes (two words
of a language share one with a chance of 2^-63 a pair). A task combines about a million edges, deals them out by hash
into bins, and hands on each bin as one row of packed numbers, so a frequent phrase is one number per million words and no
bin is larger than another. Bins are summed with numpy; what a bin sums for the next shorter size goes on to other bins.
The number of bins follows the number of words.

Edges that reach the threshold form the graph of the candidates. A node there is unary if one edge enters, one leaves, and
both weigh what it weighs; nothing shorter inside can outdo the longer phrase. Chains through unary nodes are compacted
by doubling steps: each edge learns the head of its chain and its place in it.

Null and empty texts have no words; a null language counts as `und`. Repeated rows count each time. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcorpus.llm.batches import release, shared, slices
from semcorpus.llm.components import cut, drop
from semcorpus.llm.words import kind_of, mix, words

MOST = 4
BREAKS = b".,;:!?\n\v\f\r"
KIND = kind_of(b" \t" + BREAKS)
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
# Words with a number of their own: so many in all, and so many of each language.
TABLE, TABLE_LANG = 1 << 20, (1 << 16) - 2
# Bits of the filter that tells rare words from frequent ones without a number.
FILTER_BITS = 25
SLICE, EDGES, BIN = 2 << 20, 1 << 20, 1 << 20
SHARES = 256
ONE = np.uint64(1)


class Slice(NamedTuple):
    lang: np.ndarray  # of each word, as a place in `langs`
    langs: list[str]
    key: np.ndarray  # hash of language and word; the last bit is free
    joined: np.ndarray  # whether the next word follows in the same piece
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def parsed(batches, rows: int = SLICE):
    """The words of some MB of text at a time; columns are text and lang."""
    for batch in batches:
        for lo, hi in slices(batch.column(0), rows):
            w = words(batch.column(0).slice(lo, hi - lo), KIND)
            lang = batch.column(1).slice(lo, hi - lo).dictionary_encode()
            langs = lang.dictionary.to_pylist()
            code = np.repeat(lang.indices.to_numpy(zero_copy_only=False), w.counts)
            salts = np.array([_salt(x) for x in langs], np.uint64)
            key = mix(w.hash ^ salts[code]) & ~ONE if len(code) else np.zeros(0, np.uint64)
            breaks = np.zeros(len(w.raw) + 1, np.int32)
            np.cumsum(_BREAK[w.raw], out=breaks[1:])
            joined = np.zeros(len(key), bool)
            joined[:-1] = breaks[w.start[1:]] == breaks[w.end[:-1]]
            last = np.cumsum(w.counts)[w.counts > 0] - 1
            joined[last] = False
            yield Slice(code, langs, key, joined, w.start, w.end, w.raw)


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    spots = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    data = KIND.low[raw[spots]]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """lang, key, word, n of every word that occurs `least` times in its language; with a null word, the number of all."""

    def run(batches):
        for s in parsed(batches):
            if not len(s.key):
                continue
            key, first, n = np.unique(s.key, return_index=True, return_counts=True)
            lang = pa.array(s.langs).take(pa.array(s.lang[first]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(key.view(np.int64)), _strings(s.raw, s.start[first], s.end[first]), pa.array(n)], names=["lang", "key", "word", "n"])
            total = np.bincount(s.lang, minlength=len(s.langs))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(s.langs).take(pa.array(some)), pa.array(np.zeros(len(some), np.int64)), pa.nulls(len(some), pa.string()), pa.array(total[some])], names=["lang", "key", "word", "n"])

    found = texts.mapInArrow(run, "lang string, key long, word string, n long")
    found = found.groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | F.col("word").isNull())


class Known(NamedTuple):
    """Frequent words: sorted keys with their numbers, the keys by number for each language, and a filter of all."""

    key: np.ndarray
    number: np.ndarray
    by_lang: dict[str, np.ndarray]
    bits: np.ndarray

    def numbers(self, key: np.ndarray) -> np.ndarray:
        """From 1; 0 for words without one."""
        if not len(self.key):
            return np.zeros(len(key), np.uint64)
        spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[spot] == key, self.number[spot], 0).astype(np.uint64)

    def frequent(self, key: np.ndarray) -> np.ndarray:
        """False only for rare words."""
        return _bit(self.bits, key >> np.uint64(1)) & _bit(self.bits, key >> np.uint64(1 + FILTER_BITS))


def _bit(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
    spot = spot & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & ONE).astype(bool)


def first_of(rows: DataFrame, number: str, most: int, order: list, key: str) -> DataFrame:
    """The first rows of each language, numbered from 1. Shares of a language by a hash are cut first, so that no task sorts
    more than a share of the largest or the first rows of all shares."""
    share = F.pmod(F.xxhash64(key), F.lit(SHARES))
    for by in ([F.col("lang"), share], [F.col("lang")]):
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(number) <= most)
    return rows


def known_words(counts: DataFrame) -> Known:
    """At most `TABLE` words with numbers and a filter of 2^25 bits, whatever the corpus."""
    own = counts.where("word IS NOT NULL").select("lang", "key", "n")
    # Sixteen steps to each doubling; whole steps from the top, as many as there is room for. A row per language and step.
    step = F.floor(F.log2("n") * 16)
    least, room, left, shut = {}, {}, TABLE, set()
    for r in sorted(own.groupBy("lang", step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        lang = r["lang"]
        if lang in shut or min(room.setdefault(lang, TABLE_LANG), left) < r["count"]:
            shut.add(lang)
            continue
        least[lang], room[lang], left = r["step"], room[lang] - r["count"], left - r["count"]
    cuts = F.broadcast(counts.sparkSession.createDataFrame(list(least.items()), "lang string, least long"))
    top = own.join(cuts, "lang").where(step >= F.col("least")).select("lang", "key", "n").toArrow()
    half = 1 << FILTER_BITS
    spots = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("key", s), F.lit(half)) for s in (1, 1 + FILTER_BITS)])).alias("spot")
    words64 = own.select(spots).select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, CAST(spot & 63 AS INT))").alias("bit"))
    words64 = words64.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(half >> 6, np.uint64)
    bits[words64.column(0).to_numpy().astype(np.int64)] = words64.column(1).to_numpy().view(np.uint64)
    key, n = top.column(1).to_numpy().view(np.uint64), top.column(2).to_numpy()
    lang = top.column(0).combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    code, number, by_lang = lang.indices.to_numpy(), np.zeros(len(key), np.uint16), {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        mine = np.flatnonzero(code == i)
        mine = mine[np.lexsort((key[mine], -n[mine]))]
        number[mine] = np.arange(1, len(mine) + 1)
        by_lang[name] = np.concatenate([np.zeros(1, np.uint64), key[mine]])
    order = np.argsort(key)
    return Known(key[order], number[order], by_lang, bits)


PACKED = "bin int, lang string, p binary, pn binary, g binary, gn binary, words array<long>, n long"
_PACKED = pa.schema([("bin", pa.int32()), ("lang", pa.string()), ("p", pa.binary()), ("pn", pa.binary()), ("g", pa.binary()), ("gn", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64())])


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a two-dimensional array in order, with the sums of their counts."""
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    return _runs(rows[order], n[order])


def _runs(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_summed` for rows in order."""
    if not len(rows):
        return rows, n
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    spots = np.flatnonzero(first)
    return rows[spots], np.add.reduceat(n, spots)


def _dealt(lang: str, p: np.ndarray, pn: np.ndarray, g: np.ndarray, gn: np.ndarray, bins: int) -> list[dict]:
    """Packed rows, one for each bin: `p` one column of numbers, `g` some columns of hashes."""
    out: dict[int, dict] = {}
    for a, b, rows, n in (("p", "pn", p, pn), ("g", "gn", g, gn)):
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        at = (h >> np.uint64(20)) % np.uint64(bins)
        order = np.argsort(at, kind="stable")
        rows, n, at = rows[order], n[order], at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
            if hi > lo:
                out.setdefault(int(at[lo]), {"bin": int(at[lo]), "lang": lang})
                out[int(at[lo])] |= {a: rows[lo:hi].tobytes(), b: n[lo:hi].tobytes()}
    return list(out.values())


def _edges(texts: DataFrame, known: Broadcast, bins: int) -> DataFrame:
    """Runs of up to four frequent words from every word on, combined by task and dealt into bins."""

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush():
            for lang, (p, g) in held.items():
                p, pn = np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                g = np.concatenate(g) if g else np.zeros((0, MOST), np.uint64)
                g, gn = _summed(g, np.ones(len(g), np.int64))
                rows = _dealt(lang, p[:, None], pn, g, gn, bins)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)
            held.clear()

        table = known.value
        for s in parsed(batches):
            n = len(s.key)
            if not n:
                continue
            number = table.numbers(s.key)
            numbered = number > 0
            usable = numbered.copy()
            rest = np.flatnonzero(~numbered)
            usable[rest] = table.frequent(s.key[rest])
            key = s.key | numbered
            size_all, size_own = usable.astype(np.int8), numbered.astype(np.int8)
            # follows[k][i]: words i to i+k are frequent and in one piece.
            all_k, own_k = usable.copy(), numbered.copy()
            for k in range(1, MOST):
                if n <= k:
                    break
                step = np.zeros(n, bool)
                step[: n - k] = s.joined[k - 1 : n - 1]
                late = np.zeros(n, bool)
                late[: n - k] = usable[k:]
                all_k &= step & late
                late[: n - k] = numbered[k:]
                own_k &= all_k & late
                size_all += all_k
                size_own += own_k
            packed = np.zeros(n, np.uint64)
            for k in range(MOST):
                part = np.zeros(n, np.uint64)
                part[: max(0, n - k)] = number[k:]
                packed |= np.where(size_own > k, part, 0).astype(np.uint64) << np.uint64(16 * (MOST - 1 - k))
            own = size_own >= 2
            other = np.flatnonzero((size_all > size_own) & (size_all >= 2))
            wide = np.zeros((len(other), MOST), np.uint64)
            for k in range(MOST):
                mine = size_all[other] > k
                wide[mine, k] = key[other[mine] + k]
            for code, lang in enumerate(s.langs):
                mine = s.lang == code
                p, g = held.setdefault(lang, ([], []))
                p.append(packed[own & mine])
                g.append(wide[mine[other]])
            size += int(own.sum()) + 2 * len(other)
            if size >= EDGES:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, PACKED)


def _level(packed: DataFrame, known: Broadcast, size: int, least: int, bins: int) -> DataFrame:
    """Sums of all runs of `size` words: those that reach `least` as rows with words, and the packed runs of one word less.
    Rows with words pass through."""

    def run(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        blob = lambda c, kind: np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x), kind)
        done = group.filter(pc.is_valid(group.column("n")))
        p, pn = _summed(blob("p", np.uint64)[:, None], blob("pn", np.int64))
        g, gn = _summed(blob("g", np.uint64).reshape(-1, size), blob("gn", np.int64))
        full = np.flatnonzero((pn >= least) & (p[:, 0] & np.uint64(0xFFFF) > 0))
        keys = known.value.by_lang.get(lang, np.zeros(1, np.uint64))
        found = [[int(keys[int(x) >> 16 * (size - 1 - k) & 0xFFFF]) for k in range(size)] for x in p[full, 0]]
        heavy = np.flatnonzero((gn >= least) & (g[:, -1] > 0))
        found += (g[heavy] & ~ONE).tolist()
        rows = [{"bin": int(mix(np.array([sum(w) & (1 << 63) - 1], np.uint64))[0] % np.uint64(bins)), "lang": lang, "words": [_signed(x) for x in w], "n": int(n)} for w, n in zip(found, [*pn[full], *gn[heavy]])]
        if size > 2:
            p, pn = _runs(p >> np.uint64(16), pn)
            g = g[:, :-1]
            # Runs of numbered words alone are counted among the numbers.
            odd = ((g > 0) & (g & ONE == 0)).any(axis=1)
            g, gn = _runs(g[odd], gn[odd])
            rows += _dealt(lang, p, pn, g, gn, bins)
        return pa.concat_tables([done, pa.Table.from_pylist(rows, schema=_PACKED)]) if rows else done

    return packed.groupBy("bin", "lang").applyInArrow(run, PACKED)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Graph(NamedTuple):
    """Tables in the shared folder."""

    words: DataFrame  # lang, key, word, n; a null word has the number of all words
    runs: DataFrame  # lang, words (keys), n: all runs of two to four words that reach the threshold


def graph(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> Graph:
    texts = _texts(docs, text_col, lang_col)
    spark = docs.sparkSession
    counts = cut(word_counts(texts, least))
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    bins = max(8, -(-total // BIN))
    known = shared(spark, known_words(counts))
    release()
    packed = _edges(texts, known, bins)
    for size in range(MOST, 1, -1):
        packed = _level(packed, known, size, least, bins)
    runs = cut(packed.where("n IS NOT NULL").select("lang", "words", "n"))
    known.destroy()
    return Graph(counts.where("word IS NULL OR n >= %d" % least), runs)


def compacted(runs: DataFrame) -> DataFrame:
    """Every edge (lang, words, n) with the first edge of its chain (`head`) and its place there (from 0).

    Each round halves the way to the head, so their number grows with the logarithm of the longest chain. A chain can't be
    a ring: what weighs the same all around would have no text that begins.
    """
    edges = runs.where(F.size("words") == MOST)
    nodes = runs.where(F.size("words") == MOST - 1).select("lang", F.col("words").alias("node"), F.col("n").alias("flow"))
    tail, front = F.slice("words", 2, MOST - 1), F.slice("words", 1, MOST - 1)
    enters = edges.groupBy("lang", tail.alias("node")).agg(F.count("*").alias("n_in"), F.max("n").alias("w_in"), F.max("words").alias("before"))
    leaves = edges.groupBy("lang", front.alias("node")).agg(F.count("*").alias("n_out"), F.max("n").alias("w_out"), F.max("words").alias("words"))
    unary = enters.join(leaves, ["lang", "node"]).join(nodes, ["lang", "node"])
    unary = unary.where("n_in = 1 AND n_out = 1 AND w_in = flow AND w_out = flow").select("lang", "words", "before")
    now = cut(edges.join(unary, ["lang", "words"], "left").select("lang", "words", "n", F.col("before").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("before").isNull().alias("done")))
    while now.where("NOT done").limit(1).count():
        far = now.select("lang", F.col("words").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"), F.col("done").alias("ends"))
        step = now.where("NOT done").join(far, ["lang", "head"])
        step = step.select("lang", "words", "n", F.when(F.col("further").isNull(), F.col("head")).otherwise(F.col("further")).alias("head"), (F.col("place") + F.col("more")).alias("place"), "ends")
        # An edge is done when the one it points to was done: that one is a head, or points to its head.
        before, now = now, cut(now.where("done").unionByName(step.withColumnRenamed("ends", "done")))
        drop(before)
    return now.select("lang", "words", "n", F.coalesce("head", "words").alias("head"), "place")


def passages(chains: DataFrame) -> DataFrame:
    """lang, head, n and size (in words) of each compacted chain."""
    return chains.groupBy("lang", "head").agg(F.max("n").alias("n"), (F.max("place") + MOST).alias("size"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, and the number of words of the passage
    that the phrase was compacted into.

    a, l and r count the phrase and the two parts of its lowest-scoring cut; score is floor(2000000 a / (l + r)). Phrases
    that a longer candidate holds with `covered` percent of their count or more are left out.
    """
    g = graph(docs, text_col, lang_col, least)
    own = g.words.where("word IS NOT NULL")
    runs = g.runs
    chains = compacted(runs)
    inside = chains.select("lang", "words", "head").join(passages(chains).select("lang", "head", "size"), ["lang", "head"]).select("lang", "words", F.col("size").alias("passage"))
    # Each run is held by those of one word more; what longer ones hold, these hold as often.
    parts = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words")
    longer = runs.where(F.size("words") > 2).select("lang", parts, "n").groupBy("lang", "words").agg(F.max("n").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(25,0)")
    kept = runs.join(longer, ["lang", "words"], "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("n") * covered)).drop("most")
    all_runs = runs.unionByName(own.select("lang", F.array("key").alias("words"), "n"))
    cuts = kept.withColumnRenamed("n", "a").select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(words, 1, k)").alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    cuts = cuts.join(all_runs.select("lang", F.col("words").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(all_runs.select("lang", F.col("words").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(10,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.select("lang", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "words").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    spelt = best.select("lang", "words", F.posexplode("words").alias("i", "key")).join(own.select("lang", "key", "word"), ["lang", "key"])
    spelt = spelt.groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("spelt"))
    phrase = F.array_join(F.transform("spelt", lambda s: s["word"]), " ")
    found = best.join(spelt, ["lang", "words"]).join(inside, ["lang", "words"], "left")
    found = found.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score", F.coalesce("passage", F.size("words").cast("long")).alias("passage"))
    found = first_of(found, "rank", top, [F.desc("score"), F.desc("a"), F.col("phrase")], "phrase").withColumn("rank", F.col("rank").cast("long"))
    total = g.words.where("word IS NULL").select("lang", "n")
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "passage")
