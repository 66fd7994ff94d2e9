from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcorpus import Settings
from semcorpus.api import SearchClient
from semcorpus.api import search as one_off
from semcorpus.functions.text import file_format, file_name, keyword_match, keyword_score, token_estimate
from semcorpus.functions.vectors import cosine_distance, embed_with, hash_embed
from semcorpus.operators import analytics as a
from semcorpus.operators import search as s
from semcorpus.sources.schemas import DOCUMENT, conform

SMALL = Settings(dim=2)


def corpus(spark, rows):
    """Rows of (doc_id, embedding, source, modality, created_at, text)."""
    df = spark.createDataFrame(
        rows, "doc_id string, embedding array<double>, source string, modality string, created_at timestamp, text_content string"
    )
    return conform(df.withColumn("uri", F.concat(F.lit("file:///"), "doc_id", F.lit(".txt"))), DOCUMENT)


@pytest.fixture(scope="module")
def rows(spark):
    day = datetime(2024, 5, 1)
    made = [
        ("a", [1.0, 0.0], "x", "text", day, "alpha beta"),
        ("b", [0.9, 0.1], "y", "image", day.replace(hour=5), "beta 100% gamma"),
        ("c", [0.5, 0.5], "x", "text", day.replace(day=2), "delta"),
        ("d", [0.0, 1.0], "y", "images", day.replace(day=2, hour=9), "alpha gamma"),
        ("e", [1.0, 0.0], "z", "text", day.replace(day=3), "twin of a"),
        ("f", None, "z", "text", day.replace(day=3), "no vector"),
        ("g", [], "z", "text", day.replace(day=3), "empty vector"),
        ("h", [0.0, 0.0], "z", "text", day.replace(day=3), "zero vector"),
        ("i", [1.0, 0.0, 0.0], "z", "text", day.replace(day=3), "wrong size"),
    ]
    return corpus(spark, made)


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_ties_go_to_the_lower_id_and_bad_vectors_never_match(rows):
    assert ids(s.search(rows, [1.0, 0.0], 10)) == ["a", "e", "b", "c", "d"]


def test_filters_run_after_the_pool_unless_asked(rows):
    assert ids(s.search(rows, [1.0, 0.0], 2, sources=["y"], candidates=2)) == []
    assert ids(s.search(rows, [1.0, 0.0], 2, sources=["y"], prefilter=True)) == ["b", "d"]


def test_both_modality_spellings_select_the_same_rows(rows):
    assert ids(s.search(rows, [1.0, 0.0], 5, modalities=["images"])) == ["b", "d"]
    assert ids(s.search(rows, [1.0, 0.0], 5, modalities=["image"])) == ["b", "d"]


def test_an_end_moment_counts_to_midnight_but_an_end_day_counts_whole(rows):
    assert ids(s.search(rows, [1.0, 0.0], 9, start="2024-05-01", end="2024-05-02")) == ["a", "b", "c"]
    by_day = s.search_by_date(rows, [1.0, 0.0], date(2024, 5, 1), date(2024, 5, 2), 9)
    assert ids(by_day) == ["a", "b", "c", "d"]


def test_bad_dates_fall_back(rows):
    now = datetime(2024, 5, 2, 1)
    assert ids(s.search(rows, [1.0, 0.0], 9, start="soon", end="later", now=now)) == ["a", "b", "c"]


def test_threshold_is_on_the_unrounded_relevance(spark):
    df = corpus(spark, [("a", [0.70004, float(np.sqrt(1 - 0.70004**2))], "x", "text", datetime(2024, 1, 1), "t")])
    assert ids(s.semantic_search(df, [1.0, 0.0], 5, 0.7)) == ["a"]
    assert ids(s.semantic_search(df, [1.0, 0.0], 5, 0.7001)) == []
    assert s.semantic_search(df, [1.0, 0.0], None, None).first()["relevance_score"] == 0.7


def test_no_filter_arguments(rows):
    assert s.search_by_source(rows, [1.0, 0.0], ["x"], 5).count() == 2
    assert s.semantic_grep(rows, [1.0, 0.0], 2).select("rel_score").first()[0] == 0.5
    assert ids(s.semantic_grep_table(rows, [1.0, 0.0], 3, regex="(?i)GAMMA|twin")) == ["e", "b", "d"]
    scored = s.semantic_grep_table(rows, [1.0, 0.0], 2, scorer=F.length("text_content").cast("double"))
    assert ids(scored) == ["b", "d"]


def test_similar_excludes_itself(rows):
    assert ids(s.search_similar(rows, "a", 2)) == ["e", "b"]
    with pytest.raises(ValueError):
        s.search_similar(rows, "f", 2)


def test_keyword_terms_are_literal(rows):
    assert ids(s.keyword_search(rows, "100% GAMMA", 5)) == ["b", "d"]
    assert ids(s.keyword_search(rows, "_", 5)) == []
    one = rows.where("doc_id = 'b'").select(keyword_score("text_content", ["beta", "zzz"]), keyword_match("text_content", ["zzz"]))
    assert tuple(one.first()) == (0.5, False)


def test_hybrid_with_no_keyword_weight_keeps_semantic_order(rows):
    found = s.hybrid_search(rows, [1.0, 0.0], "alpha", 4, 0.0)
    assert ids(found) == ["a", "e", "b", "c"]
    blended = {r["doc_id"]: r["combined_score"] for r in s.hybrid_search(rows, [1.0, 0.0], "alpha", 4, 0.3).collect()}
    assert blended["a"] == pytest.approx(0.7 + 0.3)
    assert blended["d"] == pytest.approx(0.7 / 2 + 0.3)
    with pytest.raises(ValueError):
        s.hybrid_search(rows, [1.0, 0.0])


def test_text_query_end_to_end(spark):
    texts = [("a", "the cat sat"), ("b", "stock markets fell"), ("c", "a cat and a dog")]
    df = spark.createDataFrame(texts, "doc_id string, text_content string").withColumn(
        "embedding", hash_embed("text_content", 256)
    ).withColumns({"uri": F.col("doc_id"), "modality": F.lit("text"), "source": F.lit("x"), "created_at": F.lit(datetime(2024, 1, 1))})
    df = conform(df, DOCUMENT)
    cfg = Settings(dim=256)
    client = SearchClient(spark, df, settings=cfg)
    assert client.search("cat", 2).first()["doc_id"] in ("a", "c")
    assert client.search_simple("stock markets", 1) == ["stock markets fell"]
    assert client.search("dog cat", 3, rerank=True).first()["doc_id"] == "c"
    assert client.get_stats()["document_count"] == 3
    assert one_off(df, list(df.first()["embedding"]), 1).first()["doc_id"] == "a"
    assert ids(s.rerank(df, "dog cat", 1, settings=cfg)) == ["c"]


def test_cosine_of_missing_zero_and_mismatched(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0], [1.0, 2.0]), ([], [])],
        "a array<double>, b array<double>",
    )
    assert [r[0] for r in df.select(cosine_distance("a", "b")).collect()] == [0.0, 1.0, None, None, None, None]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("Hello, hello WORLD",), ("hello world hello",), ("...",), ("",), (None,)], "t string")
    v = [r[0] for r in df.select(hash_embed("t", 32)).collect()]
    assert v[0] == v[1] and v[2:] == [None, None, None]
    assert np.linalg.norm(v[0]) == pytest.approx(1.0)


def test_model_hook(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,), ("z",)], "t string").coalesce(1)
    made = df.select(embed_with("t", lambda texts: np.array([[len(x), 1.0] for x in texts]))).collect()
    assert [r[0] for r in made] == [[3.0, 1.0], None, None, [1.0, 1.0]]


def test_rerank_with_a_model(rows):
    found = s.rerank(rows, [1.0, 0.0], 2, s.score_with("snippet", lambda texts: [len(x) for x in texts]))
    assert [(r["doc_id"], r["relevance_score"]) for r in found.collect()] == [("b", 15.0), ("d", 11.0)]


def test_stats_name_the_index(spark, rows, scratch):
    from semcorpus.operators import knn

    knn.ivf_build(rows, np.array([[1.0, 0.0], [0.0, 1.0]]), scratch)
    stats = SearchClient(spark, rows, index_path=scratch, settings=SMALL).get_stats()
    assert stats["index_exists"] and stats["index_rows"] == 5 and stats["document_count"] == 9
    none = SearchClient(spark, rows, index_path=scratch + "/none").get_stats()
    assert not none["index_exists"] and none["index_updated"] is None


def test_names_without_extension(spark):
    df = spark.createDataFrame([("file:///a/readme",), ("file:///a/x.TXT",), ("file:///a/",)], "uri string")
    assert [tuple(r) for r in df.select(file_name("uri"), file_format("uri")).collect()] == [
        ("readme", None), ("x.TXT", "TXT"), (None, None)
    ]
    assert [r[0] for r in df.select(token_estimate("uri", True)).collect()] == [4, 3, 2]


def results(spark, rows):
    """Hits of (query_id, doc_id, relevance, text)."""
    df = spark.createDataFrame(rows, "query_id string, doc_id string, relevance_score double, text_content string")
    return df.withColumns({
        "distance": 1 - F.col("relevance_score"), "source": F.lit("s"), "uri": F.concat(F.lit("/"), "doc_id"),
        "rank": F.row_number().over(__import__("pyspark").sql.Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "doc_id")),
    })


def test_equal_relevance_counts_together_against_the_budget(spark):
    hits = results(spark, [("q", "a", 0.9, "x" * 40), ("q", "b", 0.8, "y" * 40), ("q", "c", 0.8, "z" * 40)])
    assert "yyy" not in a.rag_context(hits, 25).first()["context"]
    assert "zzz" in a.rag_context(hits, 30).first()["context"]


def test_truncating_context_cuts_only_the_first_overflow(spark):
    hits = results(spark, [("q", "a", 0.9, "x" * 40), ("q", "b", 0.8, "y" * 400), ("q", "c", 0.7, "z" * 4)])
    got = a.rag_context_truncating(hits, 20).first()["context"]
    assert got == "[Source: s - a]\n\n" + "x" * 40 + "\n\n---\n\n" + "y" * 40


def test_topics_without_hits(spark):
    topics = spark.createDataFrame([("q",), ("r",)], "query_id string")
    hits = results(spark, [("q", "a", 0.9, "x")])
    status = {r["topic"]: r["status"] for r in a.coverage(topics, hits).collect()}
    assert status["q"].endswith("Excellent coverage") and status["r"].endswith("No coverage")
    assert [r["topic"] for r in a.knowledge_gaps(topics, hits, 0.7).collect()] == ["r"]
    cover = {r["topic"]: (r["document_count"], r["top_match"]) for r in a.topic_coverage(topics, hits).collect()}
    assert cover == {"q": (1, "x"), "r": (0, "No results")}
    assert {r["query_id"]: r["count"] for r in a.compare_queries(topics, hits).collect()} == {"q": 1, "r": 0}


def test_ranking_reads_no_texts_and_skips_folders(spark, tmp_path):
    import datetime

    schema = "doc_id string, uri string, modality string, source string, created_at timestamp, author string, channel string, text_content string, meta string, embedding array<double>, created_date date"
    day = datetime.date(2024, 1, 1)
    rows = [(f"d{i}", "u", "text", "s", datetime.datetime(2024, 1, 1 + i % 9), None, None, "t" * 50, None, [1.0, float(i)], day + datetime.timedelta(days=i % 9)) for i in range(90)]
    spark.createDataFrame(rows, schema).write.partitionBy("created_date").parquet(str(tmp_path / "c"))
    found = s.semantic_search(spark.read.parquet(str(tmp_path / "c")), [1.0, 3.0], 4)
    assert len(found.collect()) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    schemas = [x for x in plan.split("ReadSchema: ")[1:]]
    assert any("text_content" not in x.split("\n")[0] for x in schemas) and "dynamicpruning" in plan
