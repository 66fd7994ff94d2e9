import re

from llm_common import by_id
from semcorpus.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def expected(texts, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = {}
    for key, text in texts.items():
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    names |= found
                    hit.update(range(i, i + n))
        out[key] = (len(w), len(hit), sorted(names))
    return out


def check(spark, docs, texts, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontaminate.shared_words(docs, bench, **how))
    for key, want in expected(texts, items).items():
        assert all((r["n_words"], r["n_hit"], r["items"]) == want for r in found[key])
    return found


def test_against_brute_force(spark, documents, texts, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = check(spark, documents, texts, items)
    assert any(r["n_hit"] for rows in found.values() for r in rows)
    # Several blocks give what one block gives.
    again = by_id(decontaminate.shared_words(documents, spark.read.parquet(f"{sf}/benchmark.parquet"), block_bytes=2000))
    keep = lambda rows: [(r["n_hit"], r["items"], r["spans"], r["longest"]) for r in rows]
    assert {k: keep(v) for k, v in again.items()} == {k: keep(v) for k, v in found.items()}


def test_short_items_ties_and_case(spark):
    texts = {1: "x A b C y a B c", 2: "a b", 3: None, 4: "", 5: " ".join(f"w{i}" for i in range(30)), 6: "a b c" * 2}
    items = [(1, "a b c"), (2, "A B C"), (3, " ".join(f"w{i}" for i in range(5, 25))), (4, ""), (5, None), (6, "c")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = check(spark, docs, texts, items)
    assert found[5][0]["longest"] == 20 and [tuple(s) for s in found[5][0]["spans"]] == [(5, 25)]


def test_long_items_are_not_cut(spark):
    words_ = [f"v{i % 977}x{i}" for i in range(3000)]
    texts = {1: " ".join(words_[1000:2000]), 2: " ".join(words_[:9])}
    found = check(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, [(1, " ".join(words_))])
    assert found[1][0]["longest"] == 1000


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (None, "one two")], "item_id long, text string")
    found = by_id(decontaminate.shared_words(odd, bench))
    assert found[1][0]["n_words"] == 0 and found[5][0]["n_hit"] == 40000 and found[4][0]["n_hit"] == 2
    assert len(found[6]) == 2 and len(found[None]) == 1
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontaminate.shared_words(none, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.where("false")).count() == 10


def test_items_without_an_id(spark):
    """Their words are hit; they have no name."""
    words_ = " ".join(f"k{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"a {words_} b"), (2, "short one here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, words_), (None, "one"), (7, "short")], "item_id long, text string")
    found = by_id(decontaminate.shared_words(docs, bench))
    assert (found[1][0]["n_hit"], found[1][0]["items"]) == (14, [])
    assert (found[2][0]["n_hit"], found[2][0]["items"]) == (2, ["7"])
