"""Near-equal vectors through an inverted index with product quantisation.

1. Equal vectors form one class; only the smallest id of a class is compared. Vectors of each length make an index of their own.
2. k-means on a bounded sample gives the lists; codebooks per subspace are trained on the sample's residuals.
   Every vector is indexed: its list, its residual's codes, and the length that the codes leave out.
3. A vector also visits the lists beyond its own whose border lies so near that a partner could be there.
4. In a list, table look-ups give the distance from each visitor to each member's code. As the member's code is off
   by a known length, a lower bound on the true distance follows, and only pairs that it cannot rule out are
   computed exactly, in double precision.

Lists are cut into blocks that meet pairwise, so that no task holds a whole list. A block returns how many links
each vector has in it and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import few_rows, shared
from semcorpus.llm.components import components, cut, roots

# The index is fitted on about this many vectors, chosen by a hash of the id.
SAMPLE = 16_384
# Vectors per list aimed at, most lists (their centroids go to every task), and vectors of a list in one block.
PER_LIST, MOST_LISTS, BLOCK = 256, 4096, 1024
SUBSPACES, CODES, TURNS = 8, 64, 8
# A partner lies within a known distance; along the line to another list's centroid that distance, spread over all
# dimensions, has this many standard deviations before a border counts as too far.
REACH = 3.5
# Share of a block's pairs that codes may leave before they are thinned out by one matrix product.
DENSE = 0.02


class Index(NamedTuple):
    centres: np.ndarray
    books: np.ndarray  # subspace by code by its dimensions, rotated into place by cutting the vector
    width: int  # dimensions with padding


def unit_rows(vectors: pa.Array) -> list[bytes | None]:
    """The vectors of length one in double precision, packed; None for those that cannot be compared."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
    begin = np.cumsum(size) - size
    out: list[bytes | None] = [None] * len(vectors)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = values[begin[rows][:, None] + np.arange(n)].astype(np.float64)
        peak = np.abs(x).max(axis=1)
        good = np.isfinite(peak) & (peak > 0)
        x = x[good] / peak[good][:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
        for i, v in zip(rows[good].tolist(), x):
            out[i] = v.tobytes()
    return out


def means(rows: np.ndarray, k: int, rng: np.random.Generator, turns: int = TURNS) -> np.ndarray:
    """k-means on a sample; an empty cluster takes a random row."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(turns):
        own = nearest(rows, centres)
        for j in range(rows.shape[1]):
            total = np.bincount(own, rows[:, j], k)
            centres[:, j] = total / np.maximum(1, np.bincount(own, minlength=k))
        lost = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        centres[lost] = rows[rng.choice(len(rows), len(lost))]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)])


def build(sample: np.ndarray, lists: int) -> Index:
    rng = np.random.default_rng(17)
    centres = means(sample, lists, rng)
    left = sample - centres[nearest(sample, centres)]
    width = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
    left = np.pad(left, ((0, 0), (0, width - left.shape[1])))
    books = np.stack([means(part, CODES, rng) for part in np.split(left, SUBSPACES, axis=1)])
    return Index(centres, books, width)


def encoded(index: Index, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row's residual, and the length that they leave out."""
    left = rows - index.centres[own]
    left = np.pad(left, ((0, 0), (0, index.width - left.shape[1])))
    parts = np.split(left, SUBSPACES, axis=1)
    codes = np.stack([nearest(p, b) for p, b in zip(parts, index.books)], axis=1).astype(np.uint8)
    off = sum(((p - b[c]) ** 2).sum(axis=1) for p, b, c in zip(parts, index.books, codes.T))
    return codes, np.sqrt(off)


def visits(index: Index, rows: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
    """Other lists whose border with a row's own list lies within `reach` of it."""
    centres = index.centres
    half = (centres * centres).sum(axis=1) / 2
    apart = np.sqrt(np.maximum(1e-12, 2 * (half[own][:, None] + half) - 2 * centres[own] @ centres.T))
    score = rows @ centres.T - half
    border = (score[np.arange(len(rows)), own][:, None] - score) / apart
    border[np.arange(len(rows)), own] = np.inf
    return [np.flatnonzero(b <= reach) for b in border]


def distances(index: Index, rows: np.ndarray, here: int, codes: np.ndarray) -> np.ndarray:
    """Rows by members: distance from each row to each member's code, by one table per row and subspace."""
    left = rows - index.centres[here]
    left = np.pad(left, ((0, 0), (0, index.width - left.shape[1])))
    # Members by rows, so that a look-up copies one stretch of the table for all rows.
    out = np.zeros((len(codes), len(rows)))
    for p, book, code in zip(np.split(left, SUBSPACES, axis=1), index.books, codes.T):
        table = (book * book).sum(axis=1)[:, None] - 2 * book @ p.T + (p * p).sum(axis=1)
        out += table.take(code, axis=0)
    # Rounding may leave a distance of zero a little below it.
    return np.sqrt(np.maximum(out, 0, out=out), out=out).T


class _Rows(NamedTuple):
    id: np.ndarray
    weight: np.ndarray
    home: np.ndarray
    visits: pa.ChunkedArray  # of members; guests come without
    vectors: np.ndarray


def _read(table: pa.Table) -> _Rows:
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))
    return _Rows(table.column("id").to_numpy(), table.column("weight").to_numpy(), table.column("home").to_numpy(), table.column("visits"), vectors)


def block_links(index: Index, here: int, guests: _Rows, members: _Rows, codes: np.ndarray, off: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (place among guests, place among members), each pair of vectors in one block of all."""
    radius = np.sqrt(max(0.0, 2 - 2 * least))
    found = []
    for lo in range(0, len(guests.id), 256):
        part = slice(lo, lo + 256)
        near = distances(index, guests.vectors[part], here, codes) - off <= radius + 1e-9
        if near.mean() > DENSE:
            # Codes leave so many that one product of the block is cheaper than theirs one by one; those near the
            # threshold or above are still computed exactly.
            near &= guests.vectors[part] @ members.vectors.T >= least - 1e-9
        g, m = np.nonzero(near)
        g += lo
        # Two of one list meet twice, as guest and member: the larger id is the guest.
        keep = (guests.home[g] != here) | (guests.id[g] > members.id[m])
        g, m = g[keep], m[keep]
        for a in range(0, len(g), 1 << 16):
            x, y = g[a : a + (1 << 16)], m[a : a + (1 << 16)]
            exact = np.einsum("ij,ij->i", guests.vectors[x], members.vectors[y]) >= least
            found.append((x[exact], y[exact]))
    g = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    m = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    # A pair of two lists that visit each other is found in both: it counts in the lower one.
    twice, lower = np.zeros(len(g), bool), np.flatnonzero(guests.home[g] < here)
    found_, at = np.unique(m[lower], return_inverse=True)
    goes = members.visits.take(pa.array(found_)).to_pylist()
    twice[lower] = [home in goes[k] for home, k in zip(guests.home[g[lower]].tolist(), at.tolist())]
    return g[~twice], m[~twice]


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, sample: int = SAMPLE, per_list: int = PER_LIST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors are linked if their cosine is at least `least`. `n_links` counts the rows directly linked, `component_id` is the
    smallest id reachable and `kept` marks it. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, nor do those without an id. Vectors of every length are compared, with those of their length. Rows that
    repeat an id count as further copies, of vectors of one length. Equal vectors are linked. An empty table gives an empty result. All pairs found are exact; which pairs are found depends on the
    lists visited (see the README for the recall).
    """
    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def prepare(batches):
        for whole in batches:
            for batch in few_rows(whole, 1024):
                raw = unit_rows(batch.column(1))
                key = [r and hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vector"])

    units = cut(narrow.mapInArrow(prepare, "id long, key binary, vector binary"))
    some = units.where("key is not null and id is not null")
    classes = cut(some.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")).withColumn("size", F.octet_length("vector")))
    # A row for each length of vectors: as many as there are embedding models.
    sizes = sorted((r["size"], r["count"]) for r in classes.groupBy("size").count().collect())
    spark = vectors.sparkSession
    found, counts = spark.createDataFrame([], "rep long, component long, size int"), spark.createDataFrame([], "rep long, links long, size int")
    for size, n in sizes:
        if n > 1:
            joined, linked = _search(classes.where(F.col("size") == size).drop("size"), n, least, sample, per_list)
            found = found.unionByName(joined.withColumnRenamed("id", "rep").withColumn("size", F.lit(size)))
            counts = counts.unionByName(linked.withColumnRenamed("id", "rep").withColumn("size", F.lit(size)))
    # Written, so that Spark can split the rows of a vector with very many copies in the join.
    named = cut(classes.select("key", "size", F.col("id").alias("rep"), "weight").join(found, ["size", "rep"], "left").join(counts, ["size", "rep"], "left"))
    # Vectors that cannot be compared have no class: they go past the join, in which they would all meet.
    lone = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns if c != "key"]
    keyed = units.where("key is not null").select("id", "key").join(named, "key", "left")
    both = keyed.unionByName(units.where("key is null").select("id", "key", *lone))
    # A row without an id shares its vector's class only by chance; it stays alone.
    own = F.col("id").isNotNull()
    out = both.select(
        F.col("id").alias("vec_id"),
        F.when(own, F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(own, F.coalesce("component", "rep", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def blocks(placed: DataFrame) -> DataFrame:
    """The rows of every list, cut into blocks (i, j): its members, and the guests that visit it. Only members are asked where
    they go, so guests, which are most of the rows, come without their visits.
    """
    # At most MOST_LISTS rows each: how many blocks the members and the guests of a list make.
    sizes = placed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    guests = placed.select("id", "weight", "home", "vector", F.explode(F.concat(F.array("home"), "visits")).alias("list"))
    turns = guests.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    cuts = F.broadcast(sizes.join(turns, "list"))
    slot = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    keep = ["list", "i", "j", "member", "id", "weight", "home", "visits", "vector"]
    inside = placed.withColumn("list", F.col("home")).join(cuts, "list").withColumn("member", F.lit(True)).withColumn("i", slot(F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    outside = guests.join(cuts, "list").withColumn("member", F.lit(False)).withColumn("visits", F.lit(None).cast("array<int>")).withColumn("j", slot(F.col("g"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return inside.select(keep).unionByName(outside.select(keep))


def _search(classes: DataFrame, n: int, least: float, sample: int, per_list: int) -> tuple[DataFrame, DataFrame]:
    """(id, component) and (id, links to rows of other classes) of the classes that have links."""
    share = F.pmod(F.xxhash64(F.lit("index"), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1
    got = classes.where(share).select("vector").toArrow().column("vector").to_pylist()
    if not got:
        got = [r["vector"] for r in classes.select("vector").limit(1).collect()]
    rows = np.frombuffer(b"".join(got), np.float64).reshape(len(got), -1)
    lists = max(1, min(MOST_LISTS, n // per_list, len(rows)))
    sent = shared(classes.sparkSession, build(rows, lists))
    radius = np.sqrt(max(0.0, 2 - 2 * least))
    reach = min(radius, REACH * radius / np.sqrt(rows.shape[1]))

    def place(batches):
        for whole in batches:
            for batch in few_rows(whole, 1024):
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1)
                own = nearest(x, sent.value.centres)
                away = [v.astype(np.int32) for v in visits(sent.value, x, own, reach)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away, pa.list_(pa.int32()))], names=["id", "weight", "vector", "home", "visits"])

    placed = cut(classes.select("id", "weight", "vector").mapInArrow(place, "id long, weight long, vector binary, home int, visits array<int>"))

    def meet(table: pa.Table) -> pa.Table:
        index, here = sent.value, int(table.column("list")[0].as_py())
        flag = table.column("member")
        members, guests_ = _read(table.filter(flag)), _read(table.filter(pc.invert(flag)))
        none = pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if not len(members.id) or not len(guests_.id):
            return none
        codes, off = encoded(index, members.vectors, np.full(len(members.id), here))
        g, m = block_links(index, here, guests_, members, codes, off, least)
        if not len(g):
            return none
        a, b = guests_.id[g], members.id[m]
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        total = np.bincount(at, np.concatenate([members.weight[m], guests_.weight[g]]), len(ids)).astype(np.int64)
        linked, root = roots(a, b)
        return pa.table({"a": linked, "b": root, "links": total})

    met = blocks(placed).groupBy("list", "i", "j").applyInArrow(meet, "a long, b long, links long")
    met = cut(met)
    return components(met.select("a", "b")), met.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
