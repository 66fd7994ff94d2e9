"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Every document gets its set of word shingles, a signature and band keys. Documents with equal sets form one
   class, and only the smallest id of a class goes on.
2. Classes that share a band key are candidates. First every member of a band meets the smallest id of the band.
3. A candidate pair is compared batch by batch of its signatures; it is dropped as soon as the posterior
   probability that the similarity reaches the threshold falls below `MISS`. Survivors are verified on full sets.
4. Bands whose members are not yet in one component go on. In small ones all pairs across components meet as in 3. Large
   ones are cut into blocks that meet pairwise and bring their sets along: a task compares the signatures of all
   pairs across components, verifies survivors, likeliest first, as long as they would join two components, and
   returns only the links. What is left out is only what cannot change a component.

No task holds a whole band and no list of all pairs of a large band is made.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import release, shared, slices
from semcorpus.llm.components import components, cut
from semcorpus.llm.words import BLANK_SEPARATED, mix, words

SHINGLE = 5
# Chance that a pair that just reaches the threshold shares no band, and signature values that bands may take for it.
BAND_MISS, BAND_VALUES = 1e-4, 120
# Signature values compared by the sequential test, apart from those of the bands; values per batch.
TESTED, STEP = 64, 16
# Chance at each batch to drop a pair that reaches the threshold.
MISS = 1e-5
# Members of a band that meet in one block; the pairs of bands up to SMALL members are listed.
BLOCK, SMALL = 512, 16
# Bits of the filter that keeps sets nobody asks for from being shuffled; its size does not grow with the data.
FILTER_BITS = 1 << 25
# Bytes of text worked on at a time.
PORTION = 1 << 19



def layout(percent: int) -> tuple[int, int]:
    """Bands and values per band for a threshold: the longest bands that keep to `BAND_VALUES` at `BAND_MISS`.

    20 of 6 at 85 percent, 24 of 5 at 80. Below about 8 percent bands of one value take more than that.
    """
    for rows in range(BAND_VALUES, 0, -1):
        same = min((percent / 100) ** rows, 1 - 1e-12)
        bands = int(np.ceil(np.log(BAND_MISS) / np.log1p(-same)))
        if bands * rows <= BAND_VALUES or rows == 1:
            return bands, rows


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and how many each text has. A shorter text is one shingle."""
    found = words(texts, BLANK_SEPARATED)
    counts, h = found.counts, found.hash
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    left = (first + counts)[doc] - np.arange(len(h))  # words from here to the end of the text
    whole = counts[doc]
    begins = (left >= size) | (np.arange(len(h)) == first[doc])
    at = np.flatnonzero(begins)
    length = np.minimum(size, whole[at])
    s = length.astype(np.uint64)
    for i in range(size):
        has = i < length
        s[has] = mix(s[has] * np.uint64(0x9E3779B97F4A7C15) + h[at[has] + i])
    owner = doc[at]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.bincount(owner[new], minlength=len(texts))


def signatures(s: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Minimum of `size` hash functions over each set that has members."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    factors = np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    plus = np.random.default_rng(13).integers(1, 1 << 63, size, dtype=np.uint64)
    out = np.empty((len(starts), size), np.uint64)
    for i, (a, b) in enumerate(zip(factors, plus)):
        v = s * a
        v ^= b
        out[:, i] = np.minimum.reduceat(v, starts)
    return out >> np.uint64(32)


def _features(batches, count: int, rows: int):
    for batch in batches:
        for lo, hi in slices(batch.column(1), PORTION):
            s, counts = shingles(batch.column(1).slice(lo, hi - lo))
            some = np.flatnonzero(counts)
            n = hi - lo
            keys = np.zeros((2, n), np.uint64)
            bands = np.zeros((n, count), np.uint64)
            tested = np.zeros((n, TESTED), np.uint32)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                keys[0, some] = np.add.reduceat(mix(s), starts)
                keys[1, some] = np.add.reduceat(mix(s ^ np.uint64(0x5555555555555555)), starts)
                sig = signatures(s, counts, count * rows + TESTED)
                for k in range(count):
                    h = np.full(len(some), k + 1, np.uint64)
                    for v in sig[:, k * rows : (k + 1) * rows].T:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v)
                    bands[some, k] = h
                tested[some] = sig[:, count * rows :].astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n), pa.array(counts.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), count).cast(pa.list_(pa.int64())), pa.array([r.tobytes() for r in tested], pa.binary()),
                ],
                names=["id", "n", "k1", "k2", "bands", "sig"],
            )
    release()


def fewest(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal values with which a pair goes on.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, TESTED + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[int]) -> np.ndarray:
    """Places of the rows of a and b (signatures) that no batch drops."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(needed):
        part = slice(i * STEP, (i + 1) * STEP)
        equal = equal + (a[live, part] == b[live, part]).sum(axis=1)
        keep = equal >= least
        live, equal = live[keep], equal[keep]
    return live


def _sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TESTED)


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two hashes over the ids, gathered as words of 64 bits."""
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(bits))
    both = ids.select(F.explode(F.array(place(1), place(2))).alias("p"))
    got = both.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _asked(df: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of `df` whose id may be among `ids`; a filter of fixed size, so a join has to follow."""
    sent = shared(df.sparkSession, _filter_of(ids.distinct(), bits))
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(bits))
    two = df.select("*", place(1).alias("_p"), place(2).alias("_q"))

    def run(batches):
        for batch in batches:
            p, q = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            words_ = sent.value
            keep = (words_[p >> 6] >> (p & 63)) & (words_[q >> 6] >> (q & 63)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(keep == 1))

    return two.mapInArrow(run, df.schema)


def _sets(batches):
    for batch in batches:
        for lo, hi in slices(batch.column(1), PORTION):
            s, counts = shingles(batch.column(1).slice(lo, hi - lo))
            ends = np.cumsum(counts)
            sets = [s[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["id", "members"])
    release()


class Search:
    """One run over one table: what its steps share."""

    def __init__(self, docs: DataFrame, percent: int):
        self.docs, self.percent = docs, percent
        self.needed = fewest(percent / 100)
        count, rows = layout(percent)
        self.features = cut(docs.mapInArrow(lambda batches: _features(batches, count, rows), "id long, n long, k1 long, k2 long, bands array<long>, sig binary"))
        some = self.features.where("n > 0 and id is not null")
        # Written, so that Spark can split the rows of a text with very many copies in the joins.
        self.classes = cut(some.groupBy("k1", "k2").agg(F.min("id").alias("rep")))
        ours = some.join(self.classes.withColumnRenamed("rep", "id"), ["id", "k1", "k2"], "left_semi")
        self.reps = cut(ours.select("id", "n", "bands", "sig"))

    def bands(self) -> DataFrame:
        """(band, id, hub): members of the bands that two or more classes share; `hub` is the smallest."""
        # Dealt out once; the groups and the join use the same exchange.
        every = self.reps.select(F.explode("bands").alias("band"), "id").repartition("band")
        groups = every.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
        return cut(every.join(groups, "band"))

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are as similar as asked: sequential test, then the exact one."""
        pairs = cut(pairs.distinct())
        side = _asked(self.reps.select("id", "n", "sig"), pairs.select(F.explode(F.array("a", "b")).alias("id")))
        left = side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        right = side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        both = both.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        needed, percent = self.needed, self.percent

        def test(batches):
            for batch in batches:
                if batch.num_rows:
                    keep = survivors(_sig(batch.column(2)), _sig(batch.column(3)), needed)
                    yield batch.select([0, 1]).take(pa.array(keep))

        passed = cut(both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long"))
        ids = passed.select(F.explode(F.array("a", "b")).alias("id"))
        asked = _asked(sets, ids)

        def exact(batches):
            for batch in batches:
                read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
                keep = [alike(read(x), read(y), percent) for x, y in zip(batch.column(2), batch.column(3))]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        full = passed.join(asked.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        full = full.join(asked.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        return cut(full.select("a", "b", "ma", "mb").mapInArrow(exact, "a long, b long"))

    def open_bands(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(band, id, label, size, main): members of bands that hold more than one component, without their hub.

        `main` is the label of most members.
        """
        named = members.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("label"))
        by_label = named.groupBy("band", "label").agg(F.count("*").alias("c"))
        state = by_label.groupBy("band").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels"))
        return cut(named.join(state.where("labels > 1").drop("labels"), "band"))

    def small_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs of different components within small open bands."""
        small = members.where(F.col("size") <= SMALL)
        one = small.select("band", F.col("id").alias("a"), F.col("label").alias("la"))
        two = small.select("band", F.col("id").alias("b"), F.col("label").alias("lb"))
        return one.join(two, "band").where("a < b and la <> lb").select("a", "b")

    def large_links(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between components within large open bands, as many as it takes to join them."""
        large = members.where(F.col("size") > SMALL)
        rest = large.where("label <> main").groupBy("band").agg(F.count("*").alias("minor"))
        held = _asked(sets, large.select("id")).join(self.reps.select("id", "bands", "sig"), "id")
        large = large.join(rest, "band").join(held, "id")
        rows, cols = F.ceil(F.col("minor") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        keep = ["id", "label", "main", "sig", "bands", "members"]
        left = large.where("label <> main").select("band", own(rows).alias("i"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("j"), F.lit(True).alias("minor"), *keep)
        right = large.select("band", F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), own(cols).alias("j"), F.lit(False).alias("minor"), *keep)
        needed, percent = self.needed, self.percent

        def block(table: pa.Table) -> pa.Table:
            a, b = block_links(table, needed, percent)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return left.unionByName(right).groupBy("band", "i", "j").applyInArrow(block, "a long, b long")

    def labels(self) -> DataFrame:
        """(id, component) of the classes that are linked to a smaller one."""
        members = self.bands()
        sets = _asked(self.docs, members.select("id")).mapInArrow(_sets, "id long, members binary")
        sets = cut(sets.dropDuplicates(["id"]))
        members = members.where("id <> hub").select("band", "id", "hub")
        links = self.linked(members.select(F.col("hub").alias("a"), F.col("id").alias("b")), sets)
        left = self.open_bands(members.select("band", "id"), _near_roots(links))
        more = self.linked(self.small_pairs(left), sets).unionByName(self.large_links(left, sets))
        return components(links.unionByName(more))


def _near_roots(links: DataFrame) -> DataFrame:
    """(id, component): a smaller id that the links from hubs a to members b join it to; two steps towards the smallest.

    Enough to see which bands hold more than one group; a band left open without need only costs comparisons.
    """
    first = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    again = first.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return first.join(again, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def block_links(table: pa.Table, needed: list[int], percent: int) -> tuple[list[int], list[int]]:
    """Links of two blocks of a band: rows of lesser components (minor) against rows of any.

    A pair that shares several bands is met in the first of them only, and two minor rows only with the larger id on the left.
    """
    minor = table.column("minor").to_numpy()
    sig, ids, label = _sig(table.column("sig")), table.column("id").to_numpy(), table.column("label").to_numpy()
    main, here = table.column("main")[0].as_py(), table.column("band")[0].as_py()
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
    l, r = np.flatnonzero(minor), np.flatnonzero(~minor)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(l), 64):
        x = l[lo : lo + 64]
        p, q = np.nonzero((label[x][:, None] != label[r]) & ((label[r] == main) | (ids[x][:, None] > ids[r])))
        p, q = x[p], r[q]
        live = survivors(sig[p], sig[q], needed)
        p, q = p[live], q[live]
        both = bands[p] == bands[q]
        mine = bands[p, both.argmax(axis=1)] == here
        p, q = p[mine], q[mine]
        found.append((p, q, (sig[p] == sig[q]).sum(axis=1)))
    if not found:
        return [], []
    p, q, same = (np.concatenate(f) for f in zip(*found))
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    a, b = [], []
    for k in np.argsort(-same, kind="stable").tolist():
        i, j = p[k], q[k]
        u, v = top(int(label[i])), top(int(label[j]))
        if u != v and alike(sets[i], sets[j], percent):
            root[max(u, v)] = min(u, v)
            a.append(int(ids[i]))
            b.append(int(ids[j]))
    return a, b


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets, each in order, are as similar as asked."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Two documents are linked if 100 * intersection >= `percent` * union of their sets of distinct 5-word shingles
    (words between blanks, A-Z lower-cased; a text of fewer words is one shingle). `component_id` is the smallest id
    reachable by links; `kept` marks it. Null, empty and blank texts have no shingles and no links, and neither have rows
    without an id (component null, kept). Rows that repeat an id share a component and all their `kept`; links of
    one such row hold for the id. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run = Search(narrow, percent)
    found = run.labels()
    # Rows without shingles or id have no class: they go past the join, in which they would all meet.
    some = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = run.features.select("id", "n", "k1", "k2")
    own = rows.where(some).join(run.classes, ["k1", "k2"], "left").select("id", "n", "rep")
    alone = rows.where(~some).select("id", "n", F.col("id").alias("rep"))
    named = own.join(found.withColumnRenamed("id", "rep"), "rep", "left").unionByName(alone.withColumn("component", F.lit(None).cast("long")))
    out = named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id.

    Of rows that repeat an id one stays. Rows without an id all stay.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    gone = "_kept_id"
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    stay = named.join(kept, named[id_col].cast("long") == kept[gone], "left_semi").dropDuplicates([id_col])
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
