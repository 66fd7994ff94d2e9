"""The index that is kept current, against scans."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcorpus.operators import knn as k
from semcorpus.operators.list_index import ListIndex
from semcorpus.settings import DEFAULTS

DIM = 16


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, DIM))
    rows = []
    for n in range(600):
        v = centres[n % 6] + rng.normal(scale=0.25, size=DIM)
        rows.append((f"d{n:04d}", [float(x) for x in v], f"text {n}"))
    rows += [(f"c{n}", rows[4][1], "copy") for n in range(40)]
    bad = [("z0", [0.0] * DIM, "zero"), ("z1", None, "none"), ("z2", [1.0, 2.0], "short"), ("z3", [float("nan")] * DIM, "nan")]
    df = spark.createDataFrame(rows + bad, "doc_id string, embedding array<double>, text string").repartition(5).cache()
    asked = spark.createDataFrame([(f"q{n}", [float(x) for x in rng.normal(size=DIM)]) for n in range(30)], "query_id string, q array<double>").cache()
    return df, rows, centres, asked


@pytest.fixture
def index(data, scratch):
    df, _, centres, _ = data
    return ListIndex.build(df, f"{scratch}/index", DIM, centres=centres, subspaces=8)


def ids(df):
    return [r["doc_id"] for r in df.orderBy("distance", "doc_id").collect()]


def hits(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["distance"]) for r in df.collect())


def test_all_lists_equal_a_scan(spark, data, index):
    df, rows, centres, asked = data
    assert index.status().first().asDict() == {"version": 0, "rows": len(rows), "lists": 6, "largest_list": 140}
    want = hits(k.knn_join(asked, df, 7, DIM))
    assert hits(index.search_batch(asked, 7, 6)) == want
    small = ListIndex.open(spark, index.path, replace(DEFAULTS, broadcast_bytes=1, block_rows=11))
    assert hits(small.search_batch(asked, 7, 6)) == want
    q = centres[2].tolist()
    assert ids(index.search(q, 12, 6)) == ids(k.knn(df, q, 12))


def test_both_ways_of_a_batch_agree_on_few_lists(spark, data, index):
    asked = data[3]
    small = ListIndex.open(spark, index.path, replace(DEFAULTS, broadcast_bytes=1, block_rows=11))
    few = hits(index.search_batch(asked, 5, 2))
    assert few == hits(small.search_batch(asked, 5, 2)) and few
    by_list = {r["doc_id"]: r["ivf_list"] for r in index.rows().select("doc_id", "ivf_list").collect()}
    near = {r["query_id"]: set(index.nearest_lists(r["q"], 2)) for r in asked.collect()}
    assert all(by_list[d] in near[q] for q, _, d, _ in few)
    assert index.search_batch(asked.where("false"), 5, 2).count() == 0


def test_only_probed_folders_are_read(index):
    q = index.centres[1]
    files = index.rows(index.nearest_lists(q, 2)).inputFiles()
    assert {f.split("ivf_list=")[1][0] for f in files} == {str(n) for n in index.nearest_lists(q, 2)}


def test_exact_search_stops_early(data, index):
    df, _, centres, asked = data
    read = []
    for q in [c.tolist() for c in centres] + [r["q"] for r in asked.limit(6).collect()]:
        found, lists = index.search_exact(q, 9)
        assert ids(found) == ids(k.knn(df, q, 9))
        read.append(lists)
    assert min(read) < 3 and max(read) <= 6
    everything, lists = index.search_exact(centres[0].tolist(), 10_000)
    assert everything.count() == 640 and lists == 6


def test_codes(data, index):
    df, rows, centres, _ = data
    q = centres[3].tolist()
    assert ids(index.search_coded(q, 10, 6, 640)) == ids(k.knn(df, q, 10))
    found = 0
    for r in rows[:20]:
        want = set(ids(k.knn(df, r[1], 10)))
        found += len(want & set(ids(index.search_coded(r[1], 10, 6, 50))))
    assert found >= 180
    plan = index.search_coded(q, 10, 6, 50)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:string,list_code:binary>" in plan


def test_append_and_split(spark, data, scratch):
    df, rows, centres, asked = data
    late = F.crc32("doc_id") % 3 == 0
    first = ListIndex.build(df.where(~late), f"{scratch}/index", DIM, centres=centres)
    held = set(first.rows().inputFiles())
    second = first.append(df.where(late))
    assert held < set(second.rows().inputFiles()) and second.version == 1
    want = hits(k.knn_join(asked, df, 7, DIM))
    assert hits(second.search_batch(asked, 7, 6)) == want
    full = {int(n) for n, size in zip(second.ids, second.rows_in) if size > 120}
    third = second.split(120)
    assert full and len(third.ids) == 6 + len(full) and third.rows_in.sum() == len(rows)
    # Lists that were not split keep their files.
    of = lambda i: {f for f in i.rows([n for n in range(6) if n not in full]).inputFiles()}
    assert of(second) == of(third)
    assert hits(third.search_batch(asked, 7, len(third.ids))) == want
    for q in (centres[0].tolist(), rows[4][1]):
        assert ids(third.search_exact(q, 9)[0]) == ids(k.knn(df, q, 9))
    assert ids(third.search_coded(centres[4].tolist(), 9, len(third.ids), 640)) == ids(k.knn(df, centres[4].tolist(), 9))
    # A reader of the older version still has its files; then they go.
    assert hits(second.search_batch(asked, 7, 6)) == want
    again = ListIndex.open(spark, third.path)
    assert again.version == 2 and again.vacuum() > 0
    assert hits(again.search_batch(asked, 7, len(third.ids))) == want
    # Nothing to do is no new version.
    assert again.append(df.where("false")).version == 3 and third.split(10_000) is third


def test_two_writers(data, index):
    df = data[0]
    index.append(df.where("doc_id = 'c1'"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        index.append(df.where("doc_id = 'c2'"))


def test_equal_vectors_are_not_split(spark, scratch):
    df = spark.createDataFrame([(str(n), [1.0, 0.0]) for n in range(30)], "doc_id string, embedding array<double>")
    index = ListIndex.build(df, f"{scratch}/index", 2, centres=np.array([[1.0, 0.1], [0.0, 1.0]]), subspaces=2)
    assert index.split(5) is index
    with pytest.raises(ValueError):
        ListIndex.open(spark, f"{scratch}/none")


# --- pairs by sign hashes ----------------------------------------------------------------------------


def test_hashed_pairs(spark, data):
    df, rows, _, _ = data
    some = spark.createDataFrame([r[:2] for r in rows[:300]] + [(r[0], r[1]) for r in rows[600:]], "doc_id string, embedding array<double>").repartition(4)
    want = {(r["doc1"], r["doc2"]): r["distance"] for r in k.near_pairs(some, 0.02, DIM).collect()}
    own = replace(DEFAULTS, block_rows=17)
    found = k.near_pairs_hashed(some, 0.02, DIM, bits=6, miss=0.001, settings=own).collect()
    got = {(r["doc1"], r["doc2"]): r["distance"] for r in found}
    assert len(got) == len(found) and len(want) > 800
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(got[p] == want[p] for p in got)
    # Odd rows take no part; nothing to compare is no pair.
    assert k.near_pairs_hashed(data[0].where("doc_id like 'z%'"), 0.1, DIM).count() == 0


def test_number_of_tables():
    assert k.hash_tables(0.1, 12, 0.05) < k.hash_tables(0.1, 12, 0.01) < k.hash_tables(0.2, 12, 0.01)
    assert k.hash_tables(0.0, 12, 0.01) == 1
    with pytest.raises(ValueError):
        k.hash_tables(0.1, 12, 0.0)


# --- what is known -----------------------------------------------------------------------------------


def test_drop_known(spark):
    from semcorpus.operators.known import drop_known

    known = spark.createDataFrame([(f"u{n}",) for n in range(0, 5000, 2)] + [(None,)] * 3, "uri string")
    fresh = spark.createDataFrame([(f"u{n}", n) for n in range(100)] + [(None, -1)], "uri string, n int")
    for bits in (24, 8):
        left = drop_known(fresh, known, bits=bits)
        assert sorted(r["n"] for r in left.collect()) == [-1, *range(1, 100, 2)]
    assert drop_known(fresh.where("false"), known).count() == 0 and drop_known(fresh, known.where("false")).count() == 101
