from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcorpus import DEFAULTS
from semcorpus.operators import knn as k

DIM = 6
SCHEMA = "doc_id string, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    """Clustered vectors, a third of them copies of one, plus rows without a usable vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, DIM))
    vecs = [centres[i % 4] + rng.normal(scale=0.15, size=DIM) for i in range(160)]
    vecs += [vecs[0]] * 80
    rows = [(f"d{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    bad = [("x0", None), ("x1", []), ("x2", [0.0] * DIM), ("x3", [1.0] * (DIM + 1))]
    return spark.createDataFrame(rows + bad, SCHEMA).repartition(5).cache(), rows, centres


def brute(rows, queries, n):
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    out = {}
    for name, q in queries:
        q = np.array(q) / np.linalg.norm(q)
        d = np.round(1 - m @ q, 9) + 0.0
        out[name] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:n]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("settings", [DEFAULTS, replace(DEFAULTS, broadcast_bytes=64, block_rows=17)], ids=["shipped", "blocks"])
def test_many_queries_agree_with_brute_force(spark, data, settings):
    df, rows, centres = data
    asked = [(f"q{i}", [float(x) for x in c]) for i, c in enumerate(centres)] + [("copy", rows[0][1])]
    queries = spark.createDataFrame(asked, "query_id string, q array<double>")
    assert by_query(k.knn_join(queries, df, 7, DIM, settings=settings)) == brute(rows, asked, 7)


def test_no_usable_query(spark, data):
    empty = spark.createDataFrame([("q", [])], "query_id string, q array<double>")
    assert k.knn_join(empty, data[0], 3, DIM).count() == 0


def test_batch_equals_single(spark, data):
    df, _, centres = data
    queries = spark.createDataFrame([("q", centres[1].tolist())], "query_id string, q array<double>")
    one = [r["doc_id"] for r in k.knn(df, centres[1].tolist(), 9).collect()]
    assert by_query(k.knn_join(queries, df, 9, DIM))["q"] == one


def pairs_of(rows, limit):
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    d = np.round(1 - m @ m.T, 9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and d[i, j] < limit}


@pytest.mark.parametrize("limit", [0.01, 0.2, 0.9])
@pytest.mark.parametrize("cells", [False, True])
def test_near_pairs_agree_with_brute_force(data, limit, cells):
    df, rows, centres = data
    got = k.near_pairs(df, limit, DIM, centres if cells else None, settings=replace(DEFAULTS, block_rows=23)).collect()
    found = [(r["doc1"], r["doc2"]) for r in got]
    assert len(found) == len(set(found)) and set(found) == pairs_of(rows, limit)


def test_many_vectors_train_their_own_cells(data):
    df, rows, _ = data
    own = replace(DEFAULTS, pair_rows=50, block_rows=40)
    got = k.near_pairs(df, 0.2, DIM, settings=own).collect()
    assert {(r["doc1"], r["doc2"]) for r in got} == pairs_of(rows, 0.2)


def test_cells_send_rows_only_where_partners_can_be(data):
    df, _, centres = data
    rows = k._valid(df, "doc_id", "embedding", DIM)
    reach = k._reach(rows, centres, 0.005).agg(F.avg(F.size("cells"))).first()[0]
    assert reach < len(centres)


def test_similar_docs_keep_the_best_above(data):
    df, rows, centres = data
    want = {}
    for one, two in pairs_of(rows, 0.2):
        want.setdefault(one, []).append(two)
    m = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    got = {r["doc1"]: [x["doc2"] for x in r["similar_docs"]] for r in
           k.similar_docs(df, 0.2, 5, DIM, centres, settings=replace(DEFAULTS, block_rows=31)).collect()}
    assert got == {
        a: sorted(bs, key=lambda b: (np.round(1 - m[a] @ m[b], 9) + 0.0, b))[:5] for a, bs in want.items()
    }


def test_copies_are_listed_once(data):
    df, rows, _ = data
    groups = {r["doc_id"]: r["copies"] for r in k.distinct_vectors(df.where("doc_id like 'd%'")).collect()}
    assert groups["d000"] == 81 and sum(groups.values()) == len(rows)


def test_index_with_all_lists_equals_scan(spark, data, scratch):
    df, _, centres = data
    k.ivf_build(df, centres, scratch)
    cents = k.load_centroids(spark, scratch)
    assert np.allclose(cents, centres)
    indexed = spark.read.parquet(f"{scratch}/rows")
    q = centres[2].tolist()
    full = [r["doc_id"] for r in k.ivf_search(indexed, cents, q, 12, len(cents)).collect()]
    assert full == [r["doc_id"] for r in k.knn(df, q, 12).collect()]
    probe = k.ivf_search(indexed, cents, q, 5, 1)
    assert "PartitionFilters: [isnotnull(ivf_list" in probe._jdf.queryExecution().toString() or "PartitionFilters: [ivf_list" in probe._jdf.queryExecution().toString()
    state = k.index_status(spark, scratch).first()
    assert state["exists"] and state["rows"] == 240 and state["lists"] == 4 and state["last_updated"] is not None
    assert not k.index_status(spark, scratch + "/none").first()["exists"]


def test_trained_centroids(data):
    df, _, _ = data
    assert k.train_centroids(df, 4, DIM).shape == (4, DIM)
    assert k.train_centroids(df, 1, DIM).shape == (1, DIM)
    with pytest.raises(ValueError):
        k.train_centroids(df, 10_000, DIM)
    with pytest.raises(ValueError):
        k.train_centroids(df, 4, DIM, settings=replace(DEFAULTS, broadcast_bytes=8))


def test_search_plans_take_ordered_rows_without_a_shuffle(data):
    plan = k.knn(data[0], [1.0] * DIM, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange hash" not in plan


@pytest.mark.parametrize("keep", [None, 5])
def test_two_blocks_meet_in_bounded_memory(spark, monkeypatch, keep):
    """The kernel itself, on two full blocks: never the whole matrix of them at once."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(k, "self_join", lambda rows, n, meet, schema, per_block: meet)
    some = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, embedding array<double>")
    meet = k._pair_join(some, 0.2, 16, None, keep, "doc_id", "embedding", DEFAULTS)
    m = np.random.default_rng(5).normal(size=(2 * DEFAULTS.block_rows, 16))
    ids = np.array([f"d{i:05d}" for i in np.random.default_rng(6).permutation(len(m))], dtype=object)
    one, two = (pa.table({"id": pa.array(ids[h], pa.string()), "vec": pa.array(list(m[h]), pa.list_(pa.float64()))}) for h in (slice(0, DEFAULTS.block_rows), slice(DEFAULTS.block_rows, None)))
    tracemalloc.start()
    got = meet(one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    u = m / np.linalg.norm(m, axis=1)[:, None]
    rows, cols = np.nonzero(1 - u[:DEFAULTS.block_rows] @ u[DEFAULTS.block_rows:].T < 0.2)
    want = {tuple(sorted((ids[a], ids[DEFAULTS.block_rows + b]))) for a, b in zip(rows, cols)}
    pairs = list(zip(got["doc1"].to_pylist(), got["doc2"].to_pylist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) > 10
    assert keep is not None or set(pairs) == want


def packed_ids(spark, before):
    """Ids in the blocks that were written since, with repeats."""
    import pyarrow as pa

    (folder,) = set(blocks_of(spark)) - before
    held = [r["held"] for r in spark.read.parquet(folder).collect()]
    return sorted(i for h in held for i in pa.ipc.open_stream(bytes(h)).read_all()["id"].to_pylist())


def blocks_of(spark):
    from glob import glob

    from semcorpus.session import shared_dir

    return set(glob(f"{shared_dir(spark)}/blocks-*"))


@pytest.fixture(scope="module")
def spread_out(spark):
    """Vectors in all directions, some of them near copies of others, and odd rows."""
    rng = np.random.default_rng(8)
    scale = np.array([1.0] * 12 + [0.2] * 52)
    vecs = [rng.normal(size=64) * scale for _ in range(500)]
    vecs += [vecs[7 * i] + rng.normal(size=64) * scale * 0.05 for i in range(60)]
    rows = [(f"d{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    bad = [(None, rows[0][1]), ("x0", None), ("x1", [0.0] * 64), ("x2", [float("nan")] * 64), ("x3", [1.0])]
    return spark.createDataFrame(rows + bad, SCHEMA).repartition(5).cache(), rows


def test_blocks_are_written_once_and_not_dealt_to_each_other(spark, spread_out):
    df, rows = spread_out
    before = blocks_of(spark)
    got = k.near_pairs(df, 0.02, 64, settings=replace(DEFAULTS, block_rows=10))
    assert packed_ids(spark, before) == sorted([*(r[0] for r in rows), "x2"])
    found = [(r["doc1"], r["doc2"]) for r in got.collect()]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(found) == len(set(found)) and set(found) == pairs_of(rows, 0.02) and len(found) > 40


@pytest.mark.parametrize("limit", [0.02, 0.2, 0.5])
def test_pairs_left_out_by_a_bound_are_none(spread_out, limit):
    """Directions that leave out most pairs, with and without cells, change no result."""
    df, rows = spread_out
    basis = k._basis(k._valid(df.where("doc_id like 'd%'"), "doc_id", "embedding", 64), 560, 64, limit)
    assert limit > 0.2 or np.allclose(basis.T @ basis, np.eye(basis.shape[1]))
    centres = np.array([r[1] for r in rows[:8]])
    for cells in (None, centres):
        got = k.near_pairs(df, limit, 64, cells, settings=replace(DEFAULTS, block_rows=4)).collect()
        found = [(r["doc1"], r["doc2"]) for r in got]
        assert len(found) == len(set(found)) and set(found) == pairs_of(rows, limit)


def test_ids_that_repeat_pair_with_others_only(spark):
    rows = [("a", [1.0, 0.1, 0.0]), ("a", [0.0, 0.1, 1.0]), ("b", [1.0, 0.1, 0.0]), ("b", [0.0, 0.1, 1.0]), ("b", [0.0, 0.1, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for cells in (None, np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])):
        for size in (1, 50):
            got = k.near_pairs(df, 0.2, 3, cells, settings=replace(DEFAULTS, block_rows=size)).collect()
            assert [(r["doc1"], r["doc2"]) for r in got] == [("a", "b")] * 3


def test_shares_hold_whole_cells():
    assert k._shares({3: 2, 1: 5, 7: 25, 8: 4, 9: 5, 10: 2}, 10) == [(1, 0, 1), (3, 0, 1), (7, 1, 3), (8, 4, 1), (9, 4, 1), (10, 5, 1)]


def test_trained_cells_write_each_vector_once(spark, spread_out):
    df, rows = spread_out
    before = blocks_of(spark)
    got = k.near_pairs(df.where("doc_id <> 'x2'"), 0.65, 64, settings=replace(DEFAULTS, pair_rows=100, block_rows=2))
    assert packed_ids(spark, before) == sorted(r[0] for r in rows)
    found = [(r["doc1"], r["doc2"]) for r in got.collect()]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(found) == len(set(found)) and set(found) == pairs_of(rows, 0.65)


def test_hashed_pairs_of_full_buckets_write_each_vector_once(spark, spread_out):
    """Few bits and many tables: buckets hold more pairs than all rows do."""
    df, rows = spread_out
    own, before = replace(DEFAULTS, block_rows=40), blocks_of(spark)
    got = k.near_pairs_hashed(df, 0.3, 64, bits=2, miss=1e-6, settings=own)
    assert packed_ids(spark, before) == sorted([*(r[0] for r in rows), "x2"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = [(r["doc1"], r["doc2"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_of(rows, 0.3)
    # Both ways return the pairs that share a bucket, and no others.
    usable = k._valid(df, "doc_id", "embedding", 64).where("id like 'd%'")
    tables = k.hash_tables(0.3, 8, 0.5)
    by_bucket = {(r["doc1"], r["doc2"], r["distance"]) for r in k.near_pairs_hashed(df, 0.3, 64, bits=8, miss=0.5, settings=own).collect()}
    by_row = {tuple(r) for r in k._bucket_pairs(usable, len(rows), 0.3, 64, tables, 8, 17, "doc1 string, doc2 string, distance double", own).collect()}
    assert by_bucket == by_row and 0 < len(by_row) < len(pairs_of(rows, 0.3))
