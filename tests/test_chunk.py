import random
import re
import string

import pytest
from pyspark.sql import functions as F

from semcorpus.operators import chunk, corpus


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text_content string")


def fixed_loop(text, size, overlap):
    return [text[a:a + size + overlap] for a in range(0, len(text), size - overlap)] if len(text) > 2 * size else []


@pytest.mark.parametrize("size, overlap", [(10, 2), (10, 0), (7, 6), (1000, 200)])
def test_fixed_windows(spark, size, overlap):
    rng = random.Random(3)
    texts = ["".join(rng.choices(string.ascii_letters + "éß漢😀 ", k=n)) for n in (0, 1, 2 * size, 2 * size + 1, 3000, 9001)]
    got = {}
    for r in chunk.chunk_fixed(docs(spark, texts), size, overlap).orderBy("chunk_index").collect():
        got.setdefault(r["doc_id"].split(":")[0], []).append(r)
    for i, t in enumerate(texts):
        want = fixed_loop(t, size, overlap)
        have = got.get(f"d{i}", [])
        assert [h["text_content"] for h in have] == want
        assert [t[h["chunk_start"]:h["chunk_end"]] for h in have] == want
        assert [h["chunk_index"] for h in have] == list(range(len(want)))


def test_neighbours_share_twice_the_overlap(spark):
    text = "".join(random.Random(1).choices(string.ascii_lowercase, k=5000))
    got = [r["text_content"] for r in chunk.chunk_fixed(docs(spark, [text])).orderBy("chunk_index").collect()]
    assert got[0][-400:] == got[1][:400]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk.chunk_fixed(docs(spark, ["x"]), 10, 10)


def packed(spark, texts, size, overlap):
    rows = docs(spark, texts).select("doc_id", chunk.pack_sentences("text_content", size, overlap).alias("p")).collect()
    return [r["p"] for r in sorted(rows, key=lambda r: int(r["doc_id"][1:]))]


def test_sentences_lose_no_text(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        sents = ["".join(rng.choices("abc ", k=rng.choice([1, 5, 15, 25, 60]))).strip() + rng.choice(".!?") for _ in range(30)]
        texts.append(" ".join(sents))
    for text, out in zip(texts, packed(spark, texts, 20, 6)):
        for s in re.split(r"(?<=[.!?]) ", text):
            # Kept whole, or cut into windows that cover it.
            assert any(s in c["text_content"] for c in out) or all(
                any(s[i:i + 6] in c["text_content"] for c in out) for i in range(0, len(s) - 5)
            )


def test_a_long_sentence_in_an_empty_chunk_is_kept(spark):
    text = "x" * 1500 + ". " + "y" * 900 + ". z."
    (out,) = packed(spark, [text], 1000, 200)
    assert [len(c["text_content"]) for c in out] == [1501, 904]
    assert [c["chunk_index"] for c in out] == [0, 1]


def test_a_pipe_does_not_split(spark):
    text = ("a|b " * 600).strip() + "."
    made = chunk.chunk_sentences(docs(spark, [text])).collect()
    assert all("_sent0:" in r["doc_id"] for r in made) and made[0]["text_content"].startswith("a|b a|b")


def test_word_windows(spark):
    text = "  " + " ".join(f"w{i}" for i in range(1201)) + "\n"
    df = spark.createDataFrame([("a", text), ("b", "  "), ("c", "one")], "id string, text string")
    got = {(r["id"], r["chunk_index"]): r["text"].split() for r in chunk.chunk_words(df).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("c", 0)]
    assert got["a", 1][0] == "w400" and got["a", 3] == ["w1200"] and len(got["a", 0]) == 500


def test_two_routes_to_the_corpus(spark):
    texts = ["a" * 10, "b" * 2000, "c" * 2001, None]
    d = docs(spark, texts).withColumn("embedding", F.lit(None).cast("array<double>"))
    one = sorted(map(tuple, corpus.search_corpus(d, chunk.chunk_fixed(d)).select("doc_id", "text_content").collect()))
    two = sorted(map(tuple, corpus.build_corpus(d).select("doc_id", "text_content").collect()))
    assert one == two and [x[0] for x in one] == ["d0", "d1", "d2:0", "d2:1", "d2:2"]


def test_repair_is_idempotent(spark):
    rows = [("a", "some words", None), ("b", "more words", []), ("c", "other", [1.0]), ("d", None, None), ("e", "kept", [0.6, 0.8] + [0.0] * 14), ("f", "", None)]
    df = spark.createDataFrame(rows, "doc_id string, text_content string, embedding array<double>")
    once = corpus.repair_embeddings(df, 16)
    twice = corpus.repair_embeddings(once, 16)
    a, b = sorted(once.collect()), sorted(twice.collect())
    assert a == b
    sizes = {r["doc_id"]: r["embedding"] and len(r["embedding"]) for r in a}
    assert sizes == {"a": 16, "b": 16, "c": 16, "d": None, "e": 16, "f": None}
    assert [r["embedding"] for r in a if r["doc_id"] == "e"] == [[0.6, 0.8] + [0.0] * 14]
    hooked = corpus.embed_backfill(df, 16, lambda t: F.when(t.isNotNull(), F.array(F.lit(1.0), F.lit(2.0))))
    assert {r["doc_id"]: r["embedding"] for r in hooked.collect()}["a"] == [1.0, 2.0]


def test_null_known_ids_hide_nothing(spark):
    d = spark.createDataFrame([("a", "u1", "pdf"), ("b", "u2", "pdf")], "doc_id string, uri string, modality string")
    held = spark.createDataFrame([(None, None, "pdf"), ("a", "u1", "pdf")], d.schema)
    assert [r["doc_id"] for r in corpus.add_missing(held, d, "pdf").collect()] == ["b"]
    assert [r["doc_id"] for r in corpus.add_missing(held, d, "pdf", "uri").collect()] == ["b"]


def test_backfill_of_days_reads_their_folders(spark, tmp_path):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    rows = [(f"d{i}", "some words", None, (day + datetime.timedelta(days=i)).date()) for i in range(6)]
    schema = "doc_id string, text_content string, embedding array<double>, created_date date"
    spark.createDataFrame(rows, schema).write.partitionBy("created_date").parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    made = corpus.embed_backfill(table, 16, start=day + datetime.timedelta(days=2), end=day + datetime.timedelta(days=3))
    assert sorted(r["doc_id"] for r in made.collect()) == ["d2", "d3"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
