"""Nearest neighbours: one query, many queries, pairs under a distance, and a list-partitioned index.

Work on vectors runs in blocks: Spark spreads the rows, numpy multiplies two blocks, and only the rows
that can still matter leave the task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semcorpus.functions.vectors import as_distance, distance_to, has_vector, matrix, nearest_row, unit_rows
from semcorpus.session import shared_dir
from semcorpus.settings import DEFAULTS, Settings

PAIR = "query_id string, doc_id string, distance double"
# Room for one hit of a batch search in a broadcast: two ids, a distance and a rank.
HIT_BYTES = 512


def knn(
    corpus: DataFrame, query: Sequence[float], k: int, id_col: str = "doc_id", vec: str = "embedding"
) -> DataFrame:
    """The k rows nearest to one vector: a scan and a take-ordered, no shuffle of the corpus.

    Rows without a distance sort last and are dropped after the limit. Dropping them before it would push
    the condition below the projection and compute every distance twice.
    """
    return (
        corpus.where(has_vector(vec, len(query)))
        .withColumn("distance", distance_to(vec, query))
        .orderBy(F.col("distance").asc_nulls_last(), id_col)
        .limit(k)
        .where(F.col("distance").isNotNull())
    )


def top_per_query(pairs: DataFrame, k: int, by: str = "query_id", order: Sequence = ("distance", "doc_id")):
    """First k rows per query. Spark prunes to k per query in each task before it shuffles."""
    w = Window.partitionBy(by).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- many queries ------------------------------------------------------------------------------------


def _best(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id); ids must be sorted, so a stable sort settles ties."""
    if len(row) > k:
        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
    else:
        near = np.arange(len(row))
    return near[np.argsort(row[near], kind="stable")[:k]]


# Queries met at once inside a task: bounds the distance matrix of one batch.
QUERY_BLOCK = 512
# Rows of a block that meet the other block at once: bounds the matrix and the pairs found in it.
PAIR_BLOCK = 128
# More than rounding a distance can change it.
SLACK = 1e-8
# Small blocks of cells travel together, in shares of up to so many rows.
SHARE_ROWS = 4096
# Cells that a pair search trains at most: they only leave out pairs, and training costs rows times cells.
MOST_CELLS = 64
# Vectors that directions are chosen from, which leave out pairs by a bound; any directions give the same pairs.
BASIS_ROWS = 4096
# Bytes of packed blocks that travel to Python at a time, two blocks at least.
TRAVEL_BYTES = 8 << 20
# Packed blocks on either side of a task.
TASK_BLOCKS = 6
# Pairs checked at once: bounds the vectors gathered for them.
CHECKED = 4096


def _scan_top(
    query_ids: list[str], queries: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Top k per query over one task's batches; keeps k rows per query, whatever the task reads."""
    best: list[list[tuple[float, str]]] = [[] for _ in query_ids]
    worst = np.full(len(query_ids), np.inf)
    for batch in batches:
        ok, m = matrix(batch.column("vec"), queries.shape[1])
        ids = np.asarray(batch.column("doc_id").filter(pa.array(ok)).to_pylist(), dtype=object)
        u = unit_rows(m)
        good = np.isfinite(u).all(axis=1)
        ids, u = ids[good], u[good]
        if not len(ids):
            continue
        by_id = np.argsort(ids, kind="stable")
        ids, u = ids[by_id], u[by_id]
        for low in range(0, len(query_ids), QUERY_BLOCK):
            sims = queries[low:low + QUERY_BLOCK] @ u.T
            near = sims.max(axis=1) >= 1.0 - worst[low:low + QUERY_BLOCK] - SLACK
            for row in np.flatnonzero(near):
                d = as_distance(sims[row])
                found = [(float(d[i]), ids[i]) for i in _best(ids, d, k)]
                held = sorted(best[low + row] + found)[:k]
                best[low + row] = held
                if len(held) == k:
                    worst[low + row] = held[-1][0]
    rows = [(query_ids[q], doc, dist) for q in range(len(query_ids)) for dist, doc in best[q]]
    if rows:
        a, b, c = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())],
            names=["query_id", "doc_id", "distance"],
        )


def _blocks(rows: int, per_block: int) -> int:
    return max(-(-rows // per_block), 1)


def block_join(
    left: DataFrame, right: DataFrame, counts: dict[int, tuple[int, int]], kernel: Callable, schema: str,
    per_block: int,
) -> DataFrame:
    """Run kernel on every (left block, right block) of each cell.

    Both inputs are (cell, id, vec); counts holds the left and right rows of each cell. A cell with many
    rows is cut into blocks by a hash of the id, and its blocks meet pairwise in tasks of their own, so no
    task holds more than two blocks however full a cell is.
    """
    spark = left.sparkSession
    cuts = [(c, _blocks(a, per_block), _blocks(b, per_block)) for c, (a, b) in sorted(counts.items())]

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        if len(cuts) == 1:
            sized = df.withColumns({"lb": F.lit(cuts[0][1]), "rb": F.lit(cuts[0][2])})
        else:
            # One row per cell, and the cells are bounded with the centroids.
            sized = df.join(F.broadcast(spark.createDataFrame(cuts, "cell int, lb int, rb int")), "cell")
        return (
            sized.withColumn(own + "_no", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            .withColumn(other + "_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            # Fresh column ids, as both sides may come from one table.
            .select(*[F.col(c).alias(c) for c in ("cell", "lb_no", "rb_no", "id", "vec")])
        )

    keys = ["cell", "lb_no", "rb_no"]
    return (
        spread(left, "lb", "rb").groupBy(*keys)
        .cogroup(spread(right, "rb", "lb").groupBy(*keys))
        .applyInArrow(kernel, schema)
    )


def self_join(rows: DataFrame, count: int, kernel: Callable, schema: str, per_block: int) -> DataFrame:
    """Run kernel on every two blocks of one table, and on every block with itself, each once. Rows are (id, vec)."""
    n = _blocks(count, per_block)
    return _met(rows.withColumn("no", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n, kernel, schema)


def _met(
    placed: DataFrame, blocks: int, kernel: Callable, schema: str, dress: Callable | None = None, cells: int = 0
) -> DataFrame:
    """Run kernel on every two blocks, and on every block with itself (as one table given twice), each once.

    Rows are (no, id, vec). Each goes to its block once; a block is one packed row of a table in the shared folder, and the
    tasks that meet two blocks read that table. So the disk holds every vector once, however many blocks there are. With
    cells, rows are dressed with `home` and `reach`, and blocks meet if some rows of each reach a cell of the other.
    """
    spark, kind = placed.sparkSession, "no int, held binary, homes array<int>, reach array<int>"

    def pack(table: pa.Table) -> pa.Table:
        no = table.column("no")[0].as_py()
        table = _narrow(table.select(["id", "vec"]).combine_chunks())
        table = table if dress is None else dress(table)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        homes, reach = (table.column("home").unique().to_pylist(), np.flatnonzero(_reached(table, cells).any(axis=0))) if cells else (None, None)
        ints = pa.list_(pa.int32())
        return pa.table({
            "no": pa.array([no], pa.int32()), "held": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            "homes": pa.array([homes], ints), "reach": pa.array([reach], ints),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = pa.ipc.IpcReadOptions(use_threads=False)
        unpack = lambda held: pa.ipc.open_stream(held.as_buffer(), options=alone).read_all().combine_chunks()
        last, left = None, None
        for batch in batches:
            for i, one, j, two in zip(*(batch.column(c) for c in ("i", "one", "j", "two"))):
                if i.as_py() != last:
                    last, left = i.as_py(), unpack(one)
                found = kernel(left, left if i.as_py() == j.as_py() else unpack(two))
                yield from found.combine_chunks().to_batches(max_chunksize=8 * CHECKED)
        pa.default_memory_pool().release_unused()

    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    conf, cleanup = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup)
    # What was shuffled goes once the table is written.
    conf.set(cleanup, "true")
    try:
        packed = placed.groupBy("no").applyInArrow(pack, kind)
        packed.write.option("maxRecordsPerFile", -(-blocks // 256)).parquet(path)
    finally:
        conf.set(cleanup, before)
    _few_at_once(spark)
    held = spark.read.schema(kind).parquet(path)
    # A task has a cost of its own: each gets many blocks, but as many tasks as can run have some.
    most = max(-(-blocks // TASK_BLOCKS), int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism))))
    one, two = (
        held.coalesce(most).select(*[F.col(c).alias(name) for c, name in zip(("no", "held", "homes", "reach"), names)])
        for names in (("i", "one", "homes_i", "reach_i"), ("j", "two", "homes_j", "reach_j"))
    )
    # Either order of two blocks is met by half of them, so that tasks are alike.
    i, j = F.col("i"), F.col("j")
    once = (i == j) | ((i < j) & ((i + j) % 2 == 1)) | ((i > j) & ((i + j) % 2 == 0))
    if cells:
        once &= F.arrays_overlap("reach_i", "homes_j") & F.arrays_overlap("reach_j", "homes_i")
    return one.hint("shuffle_replicate_nl").join(two, once).select("i", "one", "j", "two").mapInArrow(run, schema)


def _few_at_once(spark: SparkSession) -> None:
    """Let few packed blocks travel to Python at a time in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= TRAVEL_BYTES:
        spark.conf.set(key, str(TRAVEL_BYTES))


def _narrow(table: pa.Table) -> pa.Table:
    """Vectors as floats where that loses nothing."""
    small = pc.cast(table.column("vec"), pa.list_(pa.float32()), safe=False)
    same = pc.cast(small, pa.list_(pa.float64())).equals(pc.cast(table.column("vec"), pa.list_(pa.float64())))
    return table.set_column(table.schema.get_field_index("vec"), "vec", small) if same else table


def _one(column: pa.ChunkedArray) -> pa.Array:
    held = column.combine_chunks()
    return pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held


def _fixed(m: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes of one length."""
    m = np.ascontiguousarray(m)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * m.itemsize), len(m), [None, pa.py_buffer(m.tobytes())])


def _reached(table: pa.Table, cells: int) -> np.ndarray:
    """Whether a row reaches a cell."""
    return np.unpackbits(_of_fixed(table.column("reach"), np.uint8), axis=1)[:, :cells].astype(bool)


def _of_fixed(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    held = _one(column)
    width = held.type.byte_width
    raw = np.frombuffer(held.buffers()[1], np.uint8)[held.offset * width:(held.offset + len(held)) * width]
    return raw.view(dtype).reshape(len(held), -1)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their unit vectors."""
    table = table.combine_chunks().sort_by("id")
    ids = np.asarray(table.column("id").to_pylist(), dtype=object)
    arr = table.column("vec").combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    _, m = matrix(arr, int(pc.list_value_length(arr)[0].as_py()))
    return ids, unit_rows(m)


def _pair_table(names: Sequence[str], a: Sequence, b: Sequence, d: Sequence) -> pa.Table:
    return pa.table(
        {names[0]: pa.array(a, pa.string()), names[1]: pa.array(b, pa.string()), names[2]: pa.array(d, pa.float64())}
    )


def _valid(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """Rows with a vector of the right size that is not all zero."""
    return df.where(has_vector(vec, dim) & F.exists(F.col(vec), lambda x: x != 0)).select(
        F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec")
    )


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, dim: int,
    query_id: str = "query_id", query_vec: str = "q", id_col: str = "doc_id", vec: str = "embedding",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Exact k nearest corpus rows of every query: query_id, doc_id, distance, rank.

    Few queries travel to the corpus: their size is checked first, every task keeps k rows per query, and
    the corpus is not shuffled. Too many queries are met block by block instead. A result that is sure to
    be small carries a broadcast hint, so that joining texts to it does not shuffle the corpus.
    """
    wanted = _valid(queries, query_id, query_vec, dim)
    room = max(settings.broadcast_bytes // (8 * dim + 16 * k), 1)
    held = wanted.limit(room + 1).toArrow()
    if held.num_rows == 0:
        return queries.sparkSession.createDataFrame([], PAIR + ", rank int")
    if held.num_rows <= room:
        ids, q = _vectors(held)
        names = list(ids)

        def scan(batches):
            return _scan_top(names, q, k, batches)

        docs = corpus.where(has_vector(vec, dim)).select(
            F.col(id_col).cast("string").alias("doc_id"), F.col(vec).cast("array<double>").alias("vec")
        )
        hits = top_per_query(docs.mapInArrow(scan, PAIR), k)
        return F.broadcast(hits) if len(names) * k * HIT_BYTES <= settings.broadcast_bytes else hits

    def meet(queries_block: pa.Table, docs_block: pa.Table) -> pa.Table:
        if not queries_block.num_rows or not docs_block.num_rows:
            return _pair_table(["query_id", "doc_id", "distance"], [], [], [])
        qi, q = _vectors(queries_block)
        di, d = _vectors(docs_block)
        dist = as_distance(q @ d.T)
        a, b, c = [], [], []
        for r in range(len(qi)):
            near = _best(di, dist[r], k)
            a += [qi[r]] * len(near)
            b += list(di[near])
            c += dist[r, near].tolist()
        return _pair_table(["query_id", "doc_id", "distance"], a, b, c)

    one_cell = F.lit(0).alias("cell")
    docs = _valid(corpus, id_col, vec, dim)
    pairs = block_join(
        wanted.select(one_cell, "id", "vec"), docs.select(one_cell, "id", "vec"),
        {0: (wanted.count(), docs.count())}, meet, PAIR, settings.block_rows,
    )
    return top_per_query(pairs, k)


# --- list-partitioned index --------------------------------------------------------------------------


def mean_vectors(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group. Elements are averaged map-side first: a group costs dim rows per task."""
    flat = df.where(has_vector(vec)).select(by, F.posexplode(vec).alias("pos", "x"))
    means = flat.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")
    )


def train_centroids(
    corpus: DataFrame, lists: int, dim: int, seed: int = 17, vec: str = "embedding", settings: Settings = DEFAULTS
) -> np.ndarray:
    """K-means centres of the unit vectors, fitted on all rows; as many lists as asked for."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists * dim * 8 > settings.broadcast_bytes:
        raise ValueError("the centroids would not fit settings.broadcast_bytes; use fewer lists")
    rows = _valid(corpus, vec, vec, dim).select("vec")
    n = rows.count()
    if n == 0:
        raise ValueError("no vectors to index")
    if n < lists:
        raise ValueError(f"{n} vectors cannot fill {lists} lists")
    if lists == 1:
        mean = mean_vectors(rows.withColumn("one", F.lit(1)), "one", "vec").first()
        return np.array([mean["vec"]])
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine").fit(
        rows.select(array_to_vector("vec").alias("features"))
    )
    return np.vstack(model.clusterCenters())


def ivf_assign(corpus: DataFrame, centroids: np.ndarray, vec: str = "embedding") -> DataFrame:
    """Add ivf_list, the nearest centroid; NULL for rows without a usable vector."""
    return corpus.withColumn("ivf_list", nearest_row(vec, centroids))


def ivf_build(corpus: DataFrame, centroids: np.ndarray, path: str, settings: Settings = DEFAULTS) -> None:
    """Write the corpus with one folder per list, and the centroids beside it.

    Rebalancing gathers a list into few files and splits a list that is too large over several tasks.
    """
    spark = corpus.sparkSession
    if centroids.nbytes > settings.broadcast_bytes:
        raise ValueError("the centroids would not fit settings.broadcast_bytes; use fewer lists")
    (
        ivf_assign(corpus, centroids).where(F.col("ivf_list").isNotNull())
        .hint("rebalance", "ivf_list")
        .write.mode("overwrite").partitionBy("ivf_list").parquet(f"{path}/rows")
    )
    table = [(i, [float(x) for x in row]) for i, row in enumerate(centroids)]
    spark.createDataFrame(table, "ivf_list int, centroid array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/centroids")


def load_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("ivf_list").toArrow()
    return matrix(rows.column("centroid").combine_chunks(), len(rows.column("centroid")[0]))[1]


def probe_lists(centroids: np.ndarray, query: Sequence[float], probes: int) -> list[int]:
    q = unit_rows(np.asarray(query, dtype=np.float64)[None, :])
    d = as_distance(unit_rows(centroids) @ q[0])
    return [int(i) for i in np.argsort(d, kind="stable")[:probes]]


def ivf_search(
    indexed: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, probes: int
) -> DataFrame:
    """The k nearest rows among the lists nearest to the query; the list predicate prunes folders."""
    return knn(indexed.where(F.col("ivf_list").isin(probe_lists(centroids, query, probes))), query, k)


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """Does the index exist, when was it last written, rows, lists and the fullest list."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        return spark.range(1).select(
            F.lit(False).alias("exists"), F.lit(None).cast("timestamp").alias("last_updated"),
            F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("lists"),
            F.lit(0).cast("long").alias("largest_list"),
        )
    written = F.timestamp_millis(F.lit(fs.getFileStatus(done).getModificationTime()))
    return list_sizes(spark.read.parquet(f"{path}/rows")).agg(
        F.lit(True).alias("exists"), F.first(written).alias("last_updated"), F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("lists"), F.max("rows").alias("largest_list"),
    )


def list_sizes(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("ivf_list").agg(F.count(F.lit(1)).alias("rows"))


# --- pairs under a distance --------------------------------------------------------------------------


def _reach(rows: DataFrame, centroids: np.ndarray, max_distance: float) -> DataFrame:
    """Each row with its home cell and every cell that could hold a row within max_distance of it.

    For unit vectors a cosine distance of t is a chord of sqrt(2t). If y lives in cell j, x lives in cell i
    and |x - y| <= r, then x is at most r beyond the plane halfway between the two centroids:
    (|x - c_j|^2 - |x - c_i|^2) / (2 |c_i - c_j|) <= r. Cells that fail this cannot hold a partner.
    """
    place = _placing(centroids, max_distance)
    dim = np.shape(centroids)[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, QUERY_BLOCK) for whole in batches for lo in range(0, whole.num_rows, QUERY_BLOCK)):
            home, near = place(unit_rows(matrix(batch.column("vec"), dim)[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("vec"), pa.array(home),
                    pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32())),
                ],
                names=["id", "vec", "home", "cells"],
            )

    return rows.mapInArrow(assign, "id string, vec array<double>, home int, cells array<int>")


def _placing(centroids: np.ndarray, max_distance: float) -> Callable:
    """From unit vectors to their home cells and the cells that they reach, as `_reach` has them."""
    c = unit_rows(np.asarray(centroids, dtype=np.float64))
    gaps = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0.0))
    radius = float(np.sqrt(2.0 * max_distance)) + 1e-6

    def place(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = u @ c.T
        home = as_distance(sims).argmin(axis=1)
        # |x - c|^2 = 2 - 2 x.c on the unit sphere.
        over = sims[np.arange(len(home)), home][:, None] - sims
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(gaps[home] > 0, over / gaps[home], 0.0)
        near = beyond <= radius
        near[np.arange(len(home)), home] = True
        return home.astype(np.int32), near

    return place


def _rough(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates along some orthogonal directions, and the length of what is left of a unit vector.

    Their products bound those of the vectors from above, as what is left of two vectors has at most the product of its lengths.
    """
    low = u @ basis
    left = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", low, low), 0.0))
    return np.hstack([low, left[:, None]]).astype(np.float32)


def _rough_slack(dim: int) -> float:
    """More than the products of `_rough` lose to rounding."""
    return 4e-7 * (dim + 8)


def _basis(rows: DataFrame, count: int, dim: int, max_distance: float) -> np.ndarray | None:
    """Directions for `_rough` that make a pair search cheapest; None where they would leave out too little.

    Chosen on a bounded sample. They decide only how soon a pair is left out, never whether it is a result.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(max(count // BASIS_ROWS, 1))) == 0
    held = rows.where(part).select("vec").limit(2 * BASIS_ROWS).toArrow()
    if not held.num_rows:
        return None
    u = unit_rows(matrix(_one(held.column("vec")), dim)[1])
    u = u[np.isfinite(u).all(axis=1)]
    if not len(u):
        return None
    values, vectors = np.linalg.eigh(u.T @ u)
    vectors = vectors[:, np.argsort(-values, kind="stable")]
    best, cost = None, float(2 * dim + 12)
    for m in [*(m for m in (16, 24, 32, 48, 64, 96, 128, 192, 256) if m < dim), dim]:
        low = _rough(u, vectors[:, :m])
        share = float((low[:256] @ low.T > 1.0 - max_distance - _rough_slack(dim)).mean())
        # A pair that is left over is gathered from memory, which costs far more than to rule it out.
        if share < 1 / 16 and m + 13 + 100 * dim * share < cost:
            best, cost = vectors[:, :m], m + 13 + 100 * dim * share
    return best


def _pair_kernel(
    dim: int, max_distance: float, keep: int | None = None, basis: np.ndarray | None = None, cells: int = 0,
    meets: Callable | None = None,
) -> Callable:
    """A kernel for two blocks: their pairs with id below doc2 and distance below max_distance; with keep, the best keep per row.

    `cells` are the cells of blocks that hold `home` and `reach`. `meets` says which pairs of rows of two blocks may be results.
    """
    names = ["doc1", "doc2", "distance"]
    least = 1.0 - max_distance - SLACK
    last: list = [None, None]

    def nearest(low: np.ndarray, high: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if keep is None:
            return low, high, d
        order = np.lexsort((high, d, low))
        low, high, d = low[order], high[order], d[order]
        first = np.arange(len(low)) - np.searchsorted(low, low, side="left") < keep
        return low[first], high[first], d[first]

    def read(table: pa.Table) -> tuple:
        u = unit_rows(matrix(_one(table.column("vec")), dim)[1])
        placed = None
        if cells:
            placed = table.column("home").to_numpy(), _reached(table, cells)
        return u, u if basis is None else _rough(u, basis), placed

    def similar(left: tuple, right: tuple, own: slice, pick: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs of some left rows with the picked right ones that may be near enough, and their similarity."""
        (lv, lw, _), (rv, rw, _) = left, right
        if basis is not None:
            near = lw[own] @ (rw if pick is None else rw[pick]).T > np.float32(least - _rough_slack(dim))
            found = np.flatnonzero(near)
            if len(found) <= near.size // 16:
                rows, cols = np.divmod(found, near.shape[1])
                rows, cols = rows + own.start, cols if pick is None else pick[cols]
                sims = np.empty(len(rows))
                for lo in range(0, len(rows), CHECKED):
                    some = slice(lo, lo + CHECKED)
                    sims[some] = np.einsum("ij,ij->i", lv[rows[some]], rv[cols[some]])
                return rows, cols, sims
        sims = lv[own] @ (rv if pick is None else rv[pick]).T
        rows, cols = np.nonzero(sims > least)
        return rows + own.start, cols if pick is None else pick[cols], sims[rows, cols]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pair_table(names, [], [], [])
        # A block meets many others one after another.
        if left is not last[0]:
            last[:] = left, read(left)
        one = last[1]
        two = one if left is right else read(right)
        # Places follow the ids, so the larger one settles ties.
        ids = pa.concat_arrays([_one(left.column("id")), _one(right.column("id"))])
        at = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int32)
        la, ra, parts = at[:left.num_rows], at[left.num_rows:], []
        for first in range(0, len(la), PAIR_BLOCK):
            own = slice(first, first + PAIR_BLOCK)
            pick = None
            if cells:
                # Two near rows each reach the other's home cell.
                (lh, lr), (rh, rr) = one[2], two[2]
                pick = lr[own].any(axis=0)[rh] & rr[:, np.unique(lh[own])].any(axis=1)
                if not pick.any():
                    continue
                pick = None if pick.all() else np.flatnonzero(pick)
            rows, cols, sims = similar(one, two, own, pick)
            d = as_distance(sims)
            # Two blocks meet once, so either side may hold the smaller id.
            good = (d < max_distance) & (ra[cols] > la[rows] if left is right else ra[cols] != la[rows])
            rows, cols, d = rows[good], cols[good], d[good]
            if meets is not None and len(rows):
                good = meets(left, right, rows, cols)
                rows, cols, d = rows[good], cols[good], d[good]
            parts.append(nearest(np.minimum(la[rows], ra[cols]), np.maximum(la[rows], ra[cols]), d))
        if not parts:
            return _pair_table(names, [], [], [])
        low, high, d = nearest(*(np.concatenate(x) for x in zip(*parts)))
        place = np.zeros(at.max() + 1, np.int64)
        place[at] = np.arange(len(at))
        return _pair_table(names, ids.take(pa.array(place[low])), ids.take(pa.array(place[high])), d)

    return meet


def _pair_join(
    vectors: DataFrame, max_distance: float, dim: int, centroids: np.ndarray | None, keep: int | None,
    id_col: str, vec: str, settings: Settings,
) -> DataFrame:
    """Pairs with id below doc2 and distance below max_distance; with keep, the best keep per row and block."""
    rows = _valid(vectors, id_col, vec, dim).where("id IS NOT NULL")
    schema = "doc1 string, doc2 string, distance double"
    n = rows.count() if centroids is None else 0
    if n > settings.pair_rows:
        # Every vector would meet every other; cells leave out those that cannot hold a partner.
        room = settings.broadcast_bytes // 8
        lists = max(int(min(n**0.5, room**0.5, room / dim, MOST_CELLS)), 1)
        centroids = train_centroids(rows, lists, dim, vec="vec", settings=settings)
    if centroids is None:
        basis = _basis(rows, n, dim, max_distance) if n > settings.block_rows else None
        return self_join(rows, n, _pair_kernel(dim, max_distance, keep, basis), schema, settings.block_rows)
    if 8 * len(centroids) * max(dim, len(centroids)) > settings.broadcast_bytes:
        raise ValueError("the centroids would not fit settings.broadcast_bytes; use fewer lists")
    homes = _reach(rows, centroids, max_distance).select("home", "id", "vec")
    # At most one row per centroid.
    counts = {r["home"]: r["n"] for r in homes.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return vectors.sparkSession.createDataFrame([], schema)
    shares = _shares(counts, min(max(settings.block_rows, SHARE_ROWS), 32 * settings.block_rows))
    sized = homes.join(F.broadcast(vectors.sparkSession.createDataFrame(shares, "home int, first int, many int")), "home")
    placed = sized.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias("no"), "id", "vec")
    place, n = _placing(centroids, max_distance), sum(counts.values())

    def dress(table: pa.Table) -> pa.Table:
        home, near = place(unit_rows(matrix(_one(table.column("vec")), dim)[1]))
        table = table.append_column("home", pa.array(home)).append_column("reach", _fixed(np.packbits(near, axis=1)))
        return table.take(pa.array(np.argsort(home, kind="stable")))

    basis = _basis(rows, n, dim, max_distance) if n > settings.block_rows else None
    meet = _pair_kernel(dim, max_distance, keep, basis, len(centroids))
    return _met(placed, shares[-1][1] + shares[-1][2], meet, schema, dress, len(centroids))


def _shares(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Cell, its first share and their number: cells that follow each other share one, a cell of more than `most` rows has several."""
    out, no, room = [], -1, 0
    for cell, n in sorted(counts.items()):
        many = _blocks(n, most)
        if many > 1 or n > room:
            out.append((cell, no + 1, many))
            no, room = no + many, most - n if many == 1 else 0
        else:
            out.append((cell, no, 1))
            room -= n
    return out


def near_pairs(
    vectors: DataFrame, max_distance: float = 0.3, dim: int = DEFAULTS.dim, centroids: np.ndarray | None = None,
    id_col: str = "doc_id", vec: str = "embedding", settings: Settings = DEFAULTS,
) -> DataFrame:
    """All pairs doc1 < doc2 closer than max_distance, each once, with their similarity.

    With centroids, given or trained for many vectors, only cells that can hold a partner are compared;
    the result is the same. Many equal
    vectors make many pairs: pass the output of distinct_vectors to list each group of copies once.
    """
    pairs = _pair_join(vectors, max_distance, dim, centroids, None, id_col, vec, settings)
    return pairs.withColumn("similarity", 1 - F.col("distance"))


def hash_tables(max_distance: float, bits: int, miss: float) -> int:
    """How many tables of so many sign bits leave out a pair at max_distance with a chance of at most miss."""
    same = (1.0 - np.arccos(np.clip(1.0 - max_distance, -1.0, 1.0)) / np.pi) ** bits
    if not 0 < miss < 1 or same <= 0:
        raise ValueError("no number of tables finds pairs at this distance")
    return 1 if same >= 1 else max(int(np.ceil(np.log(miss) / np.log1p(-same))), 1)


def _signed(rows: DataFrame, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """Each row with one code per table: the sides of random planes that its vector lies on."""
    codes_of = _signing(dim, tables, bits, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(lo, QUERY_BLOCK)
                u = unit_rows(matrix(batch.column("vec"), dim)[1])
                good = np.isfinite(u).all(axis=1)
                codes = codes_of(u[good])
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["id", "vec", "codes"]
                )

    return rows.mapInArrow(sign, "id string, vec array<double>, codes array<int>")


def _signing(dim: int, tables: int, bits: int, seed: int) -> Callable:
    """From unit vectors to their codes, one per table."""
    if not 0 < bits <= 20:
        raise ValueError("bits must be 1 to 20")
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
    weight = 1 << np.arange(bits)

    def codes_of(u: np.ndarray) -> np.ndarray:
        return ((u @ planes > 0).reshape(-1, tables, bits) * weight).sum(axis=2).astype(np.int32)

    return codes_of


def _bucket_pairs(
    rows: DataFrame, n: int, max_distance: float, dim: int, tables: int, bits: int, seed: int, schema: str, settings: Settings
) -> DataFrame:
    """The pairs of near_pairs_hashed where nearly every two rows share a bucket: blocks of all rows meet."""
    codes_of = _signing(dim, tables, bits, seed)

    def dress(table: pa.Table) -> pa.Table:
        codes = [codes_of(unit_rows(matrix(_one(table.column("vec")), dim)[1])[lo:lo + QUERY_BLOCK]) for lo in range(0, table.num_rows, QUERY_BLOCK)]
        return table.append_column("codes", _fixed(np.concatenate(codes)))

    def meets(left: pa.Table, right: pa.Table, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (_of_fixed(left.column("codes"), np.int32)[at] == _of_fixed(right.column("codes"), np.int32)[to]).any(axis=1)

    basis = _basis(rows, n, dim, max_distance) if n > settings.block_rows else None
    blocks = _blocks(n, settings.block_rows)
    placed = rows.withColumn("no", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return _met(placed, blocks, _pair_kernel(dim, max_distance, None, basis, meets=meets), schema, dress)


def near_pairs_hashed(
    vectors: DataFrame, max_distance: float = 0.1, dim: int = DEFAULTS.dim, bits: int = 12, miss: float = 0.05,
    seed: int = 17, id_col: str = "doc_id", vec: str = "embedding", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Pairs as near_pairs, of those that share a bucket in some table of sign hashes.

    Pairs found are exact; one at max_distance is left out with a chance of at most `miss`, a nearer one with a smaller one.
    near_pairs finds all. A row goes to one bucket per table; a bucket with many rows is cut into blocks, and a pair that
    shares several buckets is returned from the first of them. Where the buckets together hold more pairs than the rows do,
    each pair of rows is looked at once instead, and is a result if the two share a bucket.
    """
    tables = hash_tables(max_distance, bits, miss)
    rows = _valid(vectors, id_col, vec, dim).where("id IS NOT NULL")
    placed = _signed(rows, dim, tables, bits, seed)
    spread = placed.select("id", "vec", "codes", F.posexplode("codes").alias("table", "code")).select(
        (F.col("table") * F.lit(1 << bits) + F.col("code")).cast("int").alias("cell"), "id",
        F.struct("vec", "codes").alias("vec"),
    )
    # At most one row per bucket, and their number is tables times 2 to the power of bits.
    sizes = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()
    names, schema = ["doc1", "doc2", "distance"], "doc1 string, doc2 string, distance double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("similarity", 1 - F.col("distance"))
    n = rows.count()
    if sum(r["n"] ** 2 for r in sizes) >= n**2:
        pairs = _bucket_pairs(rows, n, max_distance, dim, tables, bits, seed, schema, settings)
        return pairs.withColumn("similarity", 1 - F.col("distance"))

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = table.column("vec").combine_chunks()
        held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
        _, codes = matrix(held.field("codes"), tables)
        ids = np.asarray(table.column("id").to_pylist(), dtype=object)
        return ids, unit_rows(matrix(held.field("vec"), dim)[1]), codes.astype(np.int32)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pair_table(names, [], [], [])
        here = left.column("cell")[0].as_py() >> bits
        li, lv, lc = read(left)
        ri, rv, rc = read(right)
        rows, cols = np.nonzero(lv @ rv.T > 1.0 - max_distance - SLACK)
        keep = (li[rows] < ri[cols]).astype(bool)
        rows, cols = rows[keep], cols[keep]
        d = as_distance(np.einsum("ij,ij->i", lv[rows], rv[cols]))
        keep = (d < max_distance) & ~(lc[rows, :here] == rc[cols, :here]).any(axis=1)
        return _pair_table(names, list(li[rows[keep]]), list(ri[cols[keep]]), d[keep])

    counts = {r["cell"]: (r["n"], r["n"]) for r in sizes}
    pairs = block_join(spread, spread, counts, meet, schema, settings.block_rows)
    return pairs.withColumn("similarity", 1 - F.col("distance"))


def similar_docs(
    vectors: DataFrame, max_distance: float = 0.3, n: int = 5, dim: int = DEFAULTS.dim,
    centroids: np.ndarray | None = None, id_col: str = "doc_id", vec: str = "embedding",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Per doc1 its n most similar doc2 above it, as one ordered array of structs.

    Every block keeps n partners per row, so groups of copies never write out all their pairs.
    """
    pairs = _pair_join(vectors, max_distance, dim, centroids, n, id_col, vec, settings)
    best = top_per_query(pairs, n, "doc1", ("distance", "doc2"))
    return best.groupBy("doc1").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "doc2", (1 - F.col("distance")).alias("similarity")))),
            lambda s: F.struct(s["doc2"].alias("doc2"), s["similarity"].alias("similarity")),
        ).alias("similar_docs")
    )


def distinct_vectors(vectors: DataFrame, id_col: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """One row per distinct vector: the smallest id that has it, and how many rows share it."""
    return vectors.where(has_vector(vec)).groupBy(vec).agg(
        F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")
    )
