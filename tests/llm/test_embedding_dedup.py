import numpy as np
import pyarrow as pa
from llm_common import by_id

from semcorpus.llm import embedding_dedup
from semcorpus.llm.components import roots


def expected(vectors, least):
    ids = list(vectors)
    rows = np.array([vectors[i] for i in ids], float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near = rows @ rows.T >= least
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    keys = np.array(ids)
    found, root = roots(np.concatenate([keys[a], keys]), np.concatenate([keys[b], keys]))
    named = dict(zip(found.tolist(), root.tolist()))
    return {i: (int(n), named[i]) for i, n in zip(ids, near.sum(axis=1))}


def made(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    rows = np.repeat(base, 4, axis=0) + rng.normal(size=(n // 4 * 4, dims)) * rng.choice([0, 0.05, 0.15, 0.3], size=(n // 4 * 4, 1))
    rows = np.concatenate([rows, np.repeat(rows[:1], 300, axis=0), rows[4] + rng.normal(size=(300, dims)) * 0.05])
    return {i: r.astype(np.float32).tolist() for i, r in enumerate(rows[rng.permutation(len(rows))])}


def test_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    vectors = made(2000, 30, 1)  # 30 is no multiple of the number of subspaces
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    found = by_id(embedding_dedup.linked_vectors(df, per_list=64), "vec_id")
    want = expected(vectors, 0.95)
    got = {i: r[0]["n_links"] for i, r in found.items()}
    # Never more links than there are, and hardly fewer.
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(found[i][0]["component_id"] == c for i, (_, c) in want.items()) >= 0.97 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for v in found.values() for r in v)


def test_one_list_is_exact(spark):
    vectors = made(400, 16, 2)
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    found = by_id(embedding_dedup.linked_vectors(df, per_list=10**6), "vec_id")
    assert {i: (r[0]["n_links"], r[0]["component_id"]) for i, r in found.items()} == expected(vectors, 0.95)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, -0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1e-300, 0.0]), (10, [1e300, 1e299]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [-1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, id int, kept int")
    found = by_id(embedding_dedup.linked_vectors(df), "vec_id")
    same = {1: 4, 2: 4, 9: 4, 10: 4}
    for i in (1, 2, 9, 10):
        assert {(r["n_links"], r["component_id"], r["kept"]) for r in found[i]} == {(same[i], 1, i == 1)}
    for i in (3, 4, 5, 6, 7, 8, 11, 12):
        assert [tuple(found[i][0])] == [(i, 0, i, True)]
    assert [tuple(r) for r in found[None]] == [(None, 0, None, True)]
    assert embedding_dedup.linked_vectors(df.where("false")).count() == 0


def test_vectors_of_every_length_are_compared(spark):
    """Three models in one table; ids of the second repeat some of the first without linking through them."""
    first, second, third = made(400, 16, 3), made(200, 24, 4), {7000 + i: [1.0, float(i // 2)] for i in range(6)}
    second = {(i if i % 5 == 0 else 5000 + i): v for i, v in second.items()}
    rows = [(i, v) for part in (first, second, third) for i, v in part.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = embedding_dedup.linked_vectors(df.where("vec_id < 7000"), per_list=10**6).collect()
    want = [(i, *x, x[1] == i) for part in (first, second) for i, x in expected(part, 0.95).items()]
    assert sorted(tuple(r) for r in got) == sorted(want)
    got = by_id(embedding_dedup.linked_vectors(df, least=0.999, per_list=10**6).where("vec_id >= 7000"), "vec_id")
    assert {i: tuple(r[0])[1:] for i, r in got.items()} == {i: (1, i // 2 * 2, i % 2 == 0) for i in third}


def test_guests_come_without_their_visits(spark, monkeypatch):
    """Every guest of a list meets every member once; only members bring the lists that they visit."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 2)
    rows = [(i, 1, bytes(8), i % 2, v) for i, v in enumerate([[1], [0], [1, 2], [], [1], [], [], [0, 2]])] + [(8, 1, bytes(8), 2, [])]
    placed = spark.createDataFrame(rows, "id long, weight long, vector binary, home int, visits array<int>")
    got = embedding_dedup.blocks(placed).collect()
    assert all(r["visits"] == (rows[r["id"]][4] if r["member"] else None) for r in got)
    for at in range(3):
        met = [(g["id"], m["id"]) for g in got for m in got if not g["member"] and m["member"] and at == g["list"] == m["list"] and (g["i"], g["j"]) == (m["i"], m["j"])]
        guests, members = [r[0] for r in rows if at in (r[3], *r[4])], [r[0] for r in rows if r[3] == at]
        assert sorted(met) == [(g, m) for g in guests for m in members]


def test_a_pair_of_lists_that_visit_each_other_counts_once():
    vectors = np.array([[1.0, 0.0], [0.999, np.sqrt(1 - 0.999**2)]])
    index = embedding_dedup.Index(vectors.copy(), np.zeros((8, 1, 1)), 8)

    def links(here, goes):
        """The vector of the other list as a guest here, where the member goes to the lists given."""
        row = lambda k, visits: embedding_dedup._Rows(np.array([k]), np.array([1]), np.array([k], np.int32), pa.chunked_array([pa.array(visits, pa.list_(pa.int32()))]), vectors[[k]])
        guest, member = row(1 - here, [None]), row(here, [goes])
        codes, off = embedding_dedup.encoded(index, member.vectors, np.array([here]))
        return len(embedding_dedup.block_links(index, here, guest, member, codes, off, 0.95)[0])

    assert (links(0, [1]), links(1, [0])) == (1, 0)
    assert (links(0, []), links(1, [])) == (1, 1)
