"""A vector index that is kept current: lists of rows around centres, with short codes beside the vectors.

    rows/part=<write>/ivf_list=<list>/   rows as given, with list_angle and list_code
    lists/v=<number>/                    one row per list: centre, widest angle, rows, and the writes that hold it
    books/                               the code book of each subspace

A build, an append and a split each write one part and then one version of the table of lists. Readers open the latest
complete version and name the folders they need, so they neither list nor read others, and they go on reading theirs
while a writer works. A version that another writer has taken makes the write fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.functions.vectors import as_distance, has_vector, matrix, unit_rows
from semcorpus.operators.knn import (
    HIT_BYTES, PAIR, SLACK, _best, _pair_table, _valid, _vectors, block_join, knn, top_per_query, train_centroids,
)
from semcorpus.settings import DEFAULTS, Settings
from semcorpus.sources.versions import commit, delete, folders, version_path, versions

VEC = "embedding"
PLACE = "struct<ivf_list:int,list_angle:double,list_code:binary>"
LISTS = "ivf_list int, centre array<double>, radius double, rows long, parts array<string>"
# What rounding can add to an angle.
ANGLE_SLACK = 1e-6


# --- codes -------------------------------------------------------------------------------------------


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Centres of a bounded sample on the driver."""
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def train_books(
    corpus: DataFrame, centres: np.ndarray, dim: int, subspaces: int, sample: int = 16_384
) -> np.ndarray:
    """Code books (subspace, code, element) of what is left of a unit vector after its centre.

    Fitted on at most `sample` rows, chosen by a hash of the vector; every row is coded.
    """
    if dim % subspaces:
        raise ValueError(f"{dim} dimensions do not fall into {subspaces} subspaces")
    rows = _valid(corpus, VEC, VEC, dim).select("vec").orderBy(F.xxhash64("vec")).limit(sample).toArrow()
    u = unit_rows(matrix(rows.column("vec").combine_chunks(), dim)[1])
    u = u[np.isfinite(u).all(axis=1)]
    if not len(u):
        raise ValueError("no vectors to index")
    c = unit_rows(centres)
    left = u - c[(u @ c.T).argmax(axis=1)]
    parts = left.reshape(len(left), subspaces, dim // subspaces)
    books = [_kmeans(parts[:, s], 256) for s in range(subspaces)]
    return np.stack([np.vstack([b, np.repeat(b[-1:], 256 - len(b), axis=0)]) for b in books])


def _codes(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, _, width = books.shape
    parts = left.reshape(len(left), m, width)
    out = np.empty((len(left), m), np.uint8)
    for s in range(m):
        b = books[s]
        out[:, s] = ((b * b).sum(axis=1) - 2 * parts[:, s] @ b.T).argmin(axis=1)
    return out


def _place(centres: np.ndarray, ids: np.ndarray, books: np.ndarray, own: dict[int, list[int]] | None = None):
    """A column function from a vector (and the list it is in) to its list, angle and code; NULL if unusable.

    With own, a row may only go to the centres that its list names.
    """
    c = unit_rows(np.asarray(centres, dtype=np.float64))

    @F.arrow_udf(PLACE)
    def placed(v: pa.Array, held: pa.Array) -> pa.Array:
        ok, m = matrix(v, c.shape[1])
        u = unit_rows(m)
        good = np.isfinite(u).all(axis=1)
        rows = np.flatnonzero(ok)[good]
        u = u[good]
        sims = u @ c.T
        if own is not None:
            allowed = np.zeros_like(sims, dtype=bool)
            old = held.to_numpy(zero_copy_only=False)[rows]
            for name, places in own.items():
                allowed[np.ix_(old == name, places)] = True
            sims = np.where(allowed, sims, -2.0)
        near = as_distance(sims).argmin(axis=1) if len(u) else np.zeros(0, np.int64)
        angle = np.arccos(np.clip(sims[np.arange(len(u)), near], -1.0, 1.0))
        codes = _codes(u - c[near], books)
        out: list = [None] * len(v)
        for i, l, a, code in zip(rows.tolist(), ids[near].tolist(), angle.tolist(), codes):
            out[i] = {"ivf_list": l, "list_angle": a, "list_code": code.tobytes()}
        kind = pa.struct([("ivf_list", pa.int32()), ("list_angle", pa.float64()), ("list_code", pa.binary())])
        return pa.array(out, kind)

    return placed.asNondeterministic()


# --- the index ---------------------------------------------------------------------------------------


@dataclass
class ListIndex:
    """One version of an index."""

    spark: SparkSession
    path: str
    version: int
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    rows_in: np.ndarray
    parts: list[list[str]]
    books: np.ndarray
    settings: Settings = field(default=DEFAULTS, repr=False)

    # --- writing ---

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, dim: int, lists: int = 0, centres: np.ndarray | None = None,
        subspaces: int = 8, settings: Settings = DEFAULTS,
    ) -> ListIndex:
        """Index every row with a usable vector. Give the number of lists to train, or their centres."""
        if centres is None:
            centres = train_centroids(corpus, lists, dim, settings=settings)
        if centres.nbytes > settings.broadcast_bytes:
            raise ValueError("the centroids would not fit settings.broadcast_bytes; use fewer lists")
        spark, n = corpus.sparkSession, len(centres)
        books = train_books(corpus, centres, dim, subspaces)
        table = [(s, [[float(x) for x in row] for row in b]) for s, b in enumerate(books)]
        spark.createDataFrame(table, "subspace int, codes array<array<double>>").coalesce(1).write.parquet(f"{path}/books")
        empty = cls(
            spark, path, -1, np.arange(n), np.asarray(centres, np.float64), np.zeros(n), np.zeros(n, np.int64),
            [[] for _ in range(n)], books, settings,
        )
        return empty.append(corpus)

    @classmethod
    def open(cls, spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> ListIndex:
        """The latest complete version."""
        known = versions(spark, f"{path}/lists")
        if not known:
            raise ValueError(f"no index at {path}")
        held = spark.read.parquet(version_path(f"{path}/lists", known[-1])).orderBy("ivf_list").collect()
        books = spark.read.parquet(f"{path}/books").orderBy("subspace").collect()
        return cls(
            spark, path, known[-1], np.array([r["ivf_list"] for r in held]),
            np.array([r["centre"] for r in held]), np.array([r["radius"] for r in held]),
            np.array([r["rows"] for r in held], np.int64), [list(r["parts"]) for r in held],
            np.array([b["codes"] for b in books]), settings,
        )

    def append(self, rows: DataFrame) -> ListIndex:
        """Add rows to their lists as further files; nothing written before is touched."""
        place = _place(self.centres, self.ids, self.books)
        part = self._write(rows.withColumn("_place", place(VEC, F.lit(0))))
        radius, rows_in = self.radius.copy(), self.rows_in.copy()
        parts = [list(p) for p in self.parts]
        for name, n, angle in self._sizes(part):
            at = int(np.searchsorted(self.ids, name))
            radius[at], rows_in[at] = max(radius[at], angle), rows_in[at] + n
            parts[at].append(part)
        return self._commit(self.ids, self.centres, radius, rows_in, parts)

    def split(self, most: int, rounds: int = 5) -> ListIndex:
        """Cut every list of more than `most` rows in two by two-means; only such lists are read and written.

        A list of equal vectors stays whole. One call halves a list once.
        """
        full = np.flatnonzero(self.rows_in > most)
        if not len(full):
            return self
        names = self.ids[full].tolist()
        rows = self.rows(names).drop("part")
        pairs = self._two_means(rows.select("ivf_list", VEC), names, rounds)
        pairs = {name: pair for name, pair in pairs.items() if not np.allclose(pair[0], pair[1])}
        if not pairs:
            return self
        fresh = int(self.ids.max()) + 1
        centres, ids, own = [], [], {}
        for k, (name, pair) in enumerate(sorted(pairs.items())):
            own[name] = [2 * k, 2 * k + 1]
            centres += [pair[0], pair[1]]
            ids += [name, fresh + k]
        place = _place(np.array(centres), np.array(ids), self.books, own)
        moved = rows.where(F.col("ivf_list").isin(list(pairs)))
        moved = moved.withColumn("_place", place(VEC, "ivf_list")).drop("ivf_list", "list_angle", "list_code")
        part = self._write(moved)
        sizes = {name: (n, angle) for name, n, angle in self._sizes(part)}
        keep = ~np.isin(self.ids, list(pairs))
        new = np.array(ids)
        order = np.argsort(np.concatenate([self.ids[keep], new]))
        join = lambda a, b: np.concatenate([a, b])[order]
        parts = [p for p, k in zip(self.parts, keep) if k] + [[part] if i in sizes else [] for i in ids]
        return self._commit(
            join(self.ids[keep], new), join(self.centres[keep], np.array(centres)),
            join(self.radius[keep], np.array([sizes.get(i, (0, 0.0))[1] for i in ids])),
            join(self.rows_in[keep], np.array([sizes.get(i, (0, 0.0))[0] for i in ids], np.int64)),
            [parts[i] for i in order],
        )

    def _write(self, placed: DataFrame) -> str:
        part = f"p{uuid.uuid4().hex}"
        (
            placed.where(F.col("_place").isNotNull()).select("*", "_place.*").drop("_place")
            .hint("rebalance", "ivf_list").write.partitionBy("ivf_list").parquet(f"{self.path}/rows/part={part}")
        )
        return part

    def _sizes(self, part: str) -> list[tuple[int, int, float]]:
        """Rows and widest angle of each list of a part; one row per list."""
        folder = f"{self.path}/rows/part={part}"
        # A part of a table without usable rows has no list folders.
        if not folders(self.spark, folder):
            return []
        held = self.spark.read.parquet(folder)
        found = held.groupBy("ivf_list").agg(F.count("*").alias("n"), F.max("list_angle").alias("angle"))
        return [(r["ivf_list"], r["n"], r["angle"]) for r in found.collect()]

    def _commit(self, ids, centres, radius, rows_in, parts) -> ListIndex:
        version = self.version + 1
        table = [
            (int(i), [float(x) for x in c], float(r), int(n), p)
            for i, c, r, n, p in zip(ids, centres, radius, rows_in, parts)
        ]
        commit(self.spark.createDataFrame(table, LISTS), f"{self.path}/lists", version)
        return ListIndex(
            self.spark, self.path, version, np.asarray(ids), np.asarray(centres), np.asarray(radius),
            np.asarray(rows_in), parts, self.books, self.settings,
        )

    def _two_means(self, rows: DataFrame, names: list[int], rounds: int) -> dict[int, np.ndarray]:
        """Two centres per list. Each round reads the lists once; tasks send one sum per list and side."""
        far = rows.withColumn("_angle", self._angle_to({n: self.centres[i] for i, n in enumerate(self.ids.tolist()) if n in names}))
        one = {r["ivf_list"]: np.array(r["v"]) for r in far.groupBy("ivf_list").agg(F.max_by(VEC, "_angle").alias("v")).collect()}
        far = rows.withColumn("_angle", self._angle_to(one))
        two = {r["ivf_list"]: np.array(r["v"]) for r in far.groupBy("ivf_list").agg(F.max_by(VEC, "_angle").alias("v")).collect()}
        pairs = {n: unit_rows(np.vstack([one[n], two[n]])) for n in one}
        for _ in range(rounds):
            found = rows.mapInArrow(_side_sums(pairs), "ivf_list int, side int, n long, total array<double>")
            flat = found.select("ivf_list", "side", F.posexplode("total").alias("pos", "x"))
            sums = flat.groupBy("ivf_list", "side", "pos").agg(F.sum("x").alias("x")).groupBy("ivf_list", "side").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v")
            )
            fresh = {n: p.copy() for n, p in pairs.items()}
            for r in sums.collect():
                fresh[r["ivf_list"]][r["side"]] = np.array(r["v"])
            fresh = {n: unit_rows(p) for n, p in fresh.items()}
            # A sum of opposite vectors has no direction; the old centre stays.
            pairs = {n: np.where(np.isfinite(p), p, pairs[n]) for n, p in fresh.items()}
        return pairs

    def _angle_to(self, to: dict[int, np.ndarray]) -> Column:
        targets = {n: unit_rows(np.asarray(v, np.float64)[None, :])[0] for n, v in to.items()}

        @F.arrow_udf("double")
        def angle(v: pa.Array, held: pa.Array) -> pa.Array:
            u = unit_rows(matrix(v, self_dim)[1])
            out = np.full(len(v), -1.0)
            held = held.to_numpy(zero_copy_only=False)
            for n in np.unique(held):
                mine = held == n
                out[mine] = 1.0 - u[mine] @ targets[n]
            return pa.array(out)

        self_dim = self.centres.shape[1]
        return angle(F.col(VEC), F.col("ivf_list"))

    def vacuum(self) -> int:
        """Delete what the latest version does not name; no reader may be on an older one. Returns the folders deleted."""
        latest = ListIndex.open(self.spark, self.path)
        held = {(p, int(n)) for n, ps in zip(latest.ids, latest.parts) for p in ps}
        gone = 0
        for part in folders(self.spark, f"{self.path}/rows"):
            for folder in folders(self.spark, part):
                key = (part.rpartition("part=")[2], int(folder.rpartition("ivf_list=")[2]))
                if key not in held:
                    gone += delete(self.spark, folder)
        for v in versions(self.spark, f"{self.path}/lists")[:-1]:
            gone += delete(self.spark, version_path(f"{self.path}/lists", v))
        return gone

    # --- reading ---

    def rows(self, lists: Sequence[int] | None = None) -> DataFrame:
        """The rows of some lists (all by default), from the folders of those lists alone."""
        wanted = set(self.ids.tolist() if lists is None else lists)
        found = [
            f"{self.path}/rows/part={p}/ivf_list={n}" for n, ps in zip(self.ids.tolist(), self.parts) if n in wanted for p in ps
        ]
        if not found:
            any_row = next(f"{self.path}/rows/part={p}/ivf_list={n}" for n, ps in zip(self.ids.tolist(), self.parts) for p in ps)
            return self.spark.read.option("basePath", f"{self.path}/rows").parquet(any_row).where("false")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*found)

    def nearest_lists(self, query: Sequence[float], probes: int) -> list[int]:
        q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])
        d = as_distance(unit_rows(self.centres) @ q[0])
        return self.ids[np.argsort(d, kind="stable")[:probes]].tolist()

    def _fetched(self, hits: list[tuple]) -> DataFrame:
        """Whole rows of (distance, doc_id, ivf_list, part), from the folders of the hits."""
        rows = self.rows(sorted({h[2] for h in hits}))
        kind = rows.schema["doc_id"].dataType.simpleString()
        near = self.spark.createDataFrame(hits, f"distance double, doc_id {kind}, ivf_list int, part string")
        near = F.broadcast(near) if len(hits) * HIT_BYTES <= self.settings.broadcast_bytes else near
        return rows.drop("list_angle", "list_code").join(near, ["doc_id", "ivf_list", "part"])

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """The k nearest rows of the lists nearest to the query, with all their columns, in no order."""
        rows = self.rows(self.nearest_lists(query, probes or self.settings.probes))
        near = knn(rows.select("doc_id", "ivf_list", "part", VEC), query, k).select("distance", "doc_id", "ivf_list", "part")
        return rows.drop("list_angle", "list_code").join(
            F.broadcast(near) if k * HIT_BYTES <= self.settings.broadcast_bytes else near, ["doc_id", "ivf_list", "part"]
        )

    def search_exact(self, query: Sequence[float], k: int) -> tuple[DataFrame, int]:
        """The k nearest rows of all, in no order, and how many lists were read for them.

        No row of a list is nearer to the query than the angle to its centre less its widest angle. Lists are read by
        that bound, ever more at a time, until the next bound exceeds the distance of the k-th row.
        """
        q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])[0]
        angle = np.arccos(np.clip(unit_rows(self.centres) @ q, -1.0, 1.0))
        bound = 1.0 - np.cos(np.maximum(angle - self.radius - ANGLE_SLACK, 0.0)) - SLACK
        order = np.lexsort((angle, bound))
        order = order[self.rows_in[order] > 0]
        held: list[tuple] = []
        at, step = 0, 1
        while at < len(order):
            worst = held[k - 1][0] if len(held) >= k else np.inf
            take = [i for i in order[at:at + step] if bound[i] <= worst]
            if not take:
                break
            near = knn(self.rows(self.ids[take].tolist()).select("doc_id", "ivf_list", "part", VEC), query, k)
            found = near.select("distance", "doc_id", "ivf_list", "part").collect()
            held = sorted(held + [tuple(r) for r in found])[:k]
            at, step = at + len(take), 2 * step
        return self._fetched(held), at

    def search_coded(self, query: Sequence[float], k: int, probes: int | None = None, pool: int | None = None) -> DataFrame:
        """As search, but ranks by codes first: the scan reads ids and codes, and only the `pool` best (10 k by default)
        have their vectors read and compared."""
        q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])[0]
        m, _, width = self.books.shape
        table = np.einsum("smw,sw->sm", self.books, q.reshape(m, width))
        base = dict(zip(self.ids.tolist(), (unit_rows(self.centres) @ q).tolist()))

        @F.arrow_udf("double")
        def rough(code: pa.Array, held: pa.Array) -> pa.Array:
            codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), m)
            start = np.array([base[n] for n in held.to_pylist()], np.float64)
            return pa.array(1.0 - start - table[np.arange(m), codes].sum(axis=1))

        rows = self.rows(self.nearest_lists(query, probes or self.settings.probes))
        keys = ["doc_id", "ivf_list", "part"]
        many = pool or 10 * k
        near = rows.select(*keys, rough("list_code", "ivf_list").alias("rough")).orderBy("rough", "doc_id").limit(many).drop("rough")
        near = F.broadcast(near) if many * HIT_BYTES <= self.settings.broadcast_bytes else near
        return knn(rows.drop("list_angle", "list_code").join(near, keys), query, k)

    def search_batch(
        self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_vec: str = "q"
    ) -> DataFrame:
        """The k nearest rows of every query among its nearest lists: query_id, doc_id, distance, rank.

        Few queries (their size is checked) travel to the probed lists, and a task multiplies each list by its queries
        alone. Many are exploded into their lists and meet the rows list by list, in blocks; a row is sent to the blocks of
        queries that probe its list and to no other.
        """
        dim, count = self.centres.shape[1], probes or self.settings.probes
        wanted = _valid(queries, query_id, query_vec, dim)
        room = max(self.settings.broadcast_bytes // (8 * dim + 16 * k), 1)
        held = wanted.limit(room + 1).toArrow()
        if held.num_rows == 0:
            return self.spark.createDataFrame([], PAIR + ", rank int")
        c, ids = unit_rows(self.centres), self.ids
        if held.num_rows <= room:
            names, q = _vectors(held)
            near = np.argsort(as_distance(q @ c.T), axis=1, kind="stable")[:, :count]
            asked = {int(ids[n]): np.flatnonzero((near == n).any(axis=1)) for n in np.unique(near)}
            docs = self._docs(list(asked))
            hits = docs.mapInArrow(lambda batches: _probe_top(list(names), q, asked, k, batches), PAIR)
            return top_per_query(hits, k)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    u = unit_rows(matrix(batch.column("vec"), dim)[1])
                    near = np.argsort(as_distance(u @ c.T), axis=1, kind="stable")[:, :count]
                    lists = pa.array(ids[near].astype(np.int32).tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), lists], names=["id", "vec", "lists"])

        spread = wanted.mapInArrow(probe, "id string, vec array<double>, lists array<int>")
        spread = spread.select(F.explode("lists").alias("cell"), "id", "vec")
        # One row per list.
        asked = {r["cell"]: r["n"] for r in spread.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        size = dict(zip(ids.tolist(), self.rows_in.tolist()))
        counts = {n: (asked[n], size[n]) for n in asked if size[n]}
        docs = self._docs(list(counts)).select(F.col("ivf_list").alias("cell"), F.col("doc_id").alias("id"), "vec")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found: tuple[list, list, list] = ([], [], [])
            if left.num_rows and right.num_rows:
                qi, q = _vectors(left)
                di, d = _vectors(right)
                dist = as_distance(q @ d.T)
                for r in range(len(qi)):
                    near = _best(di, dist[r], k)
                    found[0].extend([qi[r]] * len(near))
                    found[1].extend(di[near])
                    found[2].extend(dist[r, near].tolist())
            return _pair_table(["query_id", "doc_id", "distance"], *found)

        return top_per_query(block_join(spread, docs, counts, meet, PAIR, self.settings.block_rows), k)

    def _docs(self, lists: list[int]) -> DataFrame:
        return self.rows(lists).where(has_vector(VEC, self.centres.shape[1])).select(
            "ivf_list", F.col("doc_id").cast("string").alias("doc_id"), F.col(VEC).cast("array<double>").alias("vec")
        )

    def status(self) -> DataFrame:
        """Version, rows, lists that hold rows, and the fullest list."""
        full = self.rows_in[self.rows_in > 0]
        row = (self.version, int(full.sum()), len(full), int(full.max(initial=0)))
        return self.spark.createDataFrame([row], "version int, rows long, lists long, largest_list long")


def _probe_top(
    names: list[str], queries: np.ndarray, asked: dict[int, np.ndarray], k: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Top k per query over one task's batches; rows meet the queries that probe their list."""
    best: dict[int, list[tuple[float, str]]] = {}
    for batch in batches:
        lists = batch.column("ivf_list").to_numpy(zero_copy_only=False)
        for n in np.unique(lists):
            part = batch.filter(pa.array(lists == n))
            ids = np.asarray(part.column("doc_id").to_pylist(), dtype=object)
            order = np.argsort(ids, kind="stable")
            u = unit_rows(matrix(part.column("vec"), queries.shape[1])[1])[order]
            ids = ids[order]
            dist = as_distance(queries[asked[int(n)]] @ u.T)
            for row, q in enumerate(asked[int(n)].tolist()):
                found = [(float(dist[row, i]), ids[i]) for i in _best(ids, dist[row], k)]
                best[q] = sorted(best.get(q, []) + found)[:k]
    rows = [(names[q], doc, d) for q, held in sorted(best.items()) for d, doc in held]
    if rows:
        a, b, d = zip(*rows)
        table = _pair_table(["query_id", "doc_id", "distance"], a, b, d)
        yield from table.combine_chunks().to_batches()


def _side_sums(pairs: dict[int, np.ndarray]):
    """Sums of a task's rows by list and nearer centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros_like(p) for n, p in pairs.items()}
        count = {n: np.zeros(2, np.int64) for n in pairs}
        for batch in batches:
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            for n in np.unique(lists):
                if n in pairs:
                    u = unit_rows(matrix(batch.column(1).filter(pa.array(lists == n)), pairs[n].shape[1])[1])
                    side = (u @ pairs[n].T).argmax(axis=1)
                    np.add.at(total[n], side, u)
                    count[n] += np.bincount(side, minlength=2)
        rows = [(int(n), s, int(count[n][s]), total[n][s].tolist()) for n in pairs for s in (0, 1) if count[n][s]]
        if rows:
            names, kinds = ["ivf_list", "side", "n", "total"], [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run
