"""Updates by day, postings, batch sinks and contexts in SQL."""

import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from semcorpus.operators import analytics as a
from semcorpus.operators import corpus as c
from semcorpus.operators import quality
from semcorpus.operators import search as s
from semcorpus.operators.daily import DailyReports
from semcorpus.operators.postings import Postings, build_postings, required
from semcorpus.sources import tables as t
from semcorpus.sources.updates import append_days, read_days, state, update_days, vacuum
from semcorpus.sql_functions import register_sql
from semcorpus.streaming import incremental as inc

ROW = "doc_id string, uri string, source string, text_content string, created_at timestamp, embedding array<double>"


@pytest.fixture
def table(spark, scratch):
    day = datetime(2024, 1, 1)
    rows = [(f"d{n}", f"u{n}", "s", f"text {n}", day + timedelta(days=n % 4, hours=n % 24), [1.0]) for n in range(40)]
    rows.append(("none", "u", "s", "no day", None, None))
    df = spark.createDataFrame(rows, ROW)
    t.write_table(df, f"{scratch}/t", sort_by=("source",))
    return f"{scratch}/t"


def values(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_only_touched_days_are_written(spark, table):
    before = set(t.read_table(spark, table).inputFiles())
    reader = t.read_table(spark, table)
    old = values(reader, "doc_id", "embedding")
    fresh = spark.createDataFrame([("d1", [2.0]), ("d5", [3.0]), ("nobody", [4.0])], "doc_id string, embedding array<double>")
    days = update_days(spark, table, lambda rows: c.write_embeddings(rows, fresh), fresh)
    assert [d.isoformat() for d in days] == ["2024-01-02"]
    now = t.read_table(spark, table)
    kept = {f for f in before if "2024-01-02" not in f}
    assert kept and kept == set(now.inputFiles()) & before and len(set(now.inputFiles()) - before) >= 1
    want = {k: v for k, v in old} | {"d1": [2.0], "d5": [3.0]}
    assert dict(values(now, "doc_id", "embedding")) == want
    # A reader of the older state still reads it.
    assert values(reader, "doc_id", "embedding") == old
    assert now.columns == reader.columns


def test_conditions_null_days_and_appends(spark, table):
    assert update_days(spark, table, c.clear_embeddings, F.col("doc_id") == "none") == [None]
    assert update_days(spark, table, c.clear_embeddings, F.col("doc_id") == "nobody") == []
    with pytest.raises(ValueError):
        t.write_table(t.read_table(spark, table), table)
    late = t.read_table(spark, table).where("doc_id = 'd3'").withColumn("doc_id", F.lit("late")).drop("created_date")
    assert append_days(late, table, "batch-1") and not append_days(late, table, "batch-1")
    assert t.read_table(spark, table).count() == 42
    days = read_days(spark, table, [datetime(2024, 1, 4).date()])
    assert {r["doc_id"] for r in days.collect()} == {"late", *[f"d{n}" for n in range(40) if n % 4 == 3]}
    version, held = state(spark, table)
    assert version == 1 and len(held) == 5 and [len(f) for d, f in held.items() if str(d) == "2024-01-04"] == [2]
    update_days(spark, table, lambda rows: rows.withColumn("text_content", F.upper("text_content")), F.col("doc_id") == "late")
    whole = values(t.read_table(spark, table), "doc_id", "text_content")
    assert vacuum(spark, table) > 0 and vacuum(spark, table) == 0
    assert values(t.read_table(spark, table), "doc_id", "text_content") == whole
    # Rows may go; rows may not change their day.
    assert update_days(spark, table, lambda rows: rows.where("doc_id <> 'late'"), F.col("doc_id") == "late")
    assert t.read_table(spark, table).count() == 41
    with pytest.raises(ValueError):
        update_days(spark, table, lambda rows: rows.withColumn("created_date", F.lit("2030-01-01").cast("date")), F.col("doc_id") == "d1")


def test_two_updates_at_once(spark, table):
    def change(rows):
        # Another writer comes first.
        update_days(spark, table, c.clear_embeddings, F.col("doc_id") == "d2")
        return c.clear_embeddings(rows)

    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        update_days(spark, table, change, F.col("doc_id") == "d1")
    assert t.read_table(spark, table).where("embedding is null").count() == 11


# --- postings ----------------------------------------------------------------------------------------

TEXTS = ["The rent is due", "no tax", "ab", "a", "", None, "ABba abBA", "x" * 50_000 + "needle", "Straße ÉTÉ İ", "the end", "a|b.c", "\U0001f600 smile the"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(str(n), "u", "text", "s", datetime(2024, 1, 1), None, None, x) for n, x in enumerate(TEXTS)]
    return spark.createDataFrame(made, "doc_id string, uri string, modality string, source string, created_at timestamp, author string, channel string, text_content string").cache()


def test_postings_equal_a_scan(spark, rows, scratch):
    build_postings(rows, scratch, 4)
    held = Postings(spark, scratch)
    for q in ("the", "a", "ab", "the tax needle", "xxx", "zzz", "straße", "été", "i̇", "e e", "\U0001f600", "abba", "b."):
        scan = [tuple(r) for r in s.keyword_search(rows, q, 5).collect()]
        assert [tuple(r) for r in held.keyword_search(rows, q, 5).collect()] == scan, q
    with pytest.raises(ValueError):
        held.keyword_search(rows, " ", 5)
    for p in ("the", "(?i)THE|NEEDLE", "^no|x+n", "a?b", "[ab]c", "th.end", "", "(the|no) .ax", "é", "\\bthe"):
        want = {r["doc_id"] for r in rows.where(F.rlike("text_content", F.lit(p))).collect()}
        assert {r["doc_id"] for r in held.matching(rows, p).collect()} == want, p


def test_candidates_read_few_folders(spark, rows, scratch):
    build_postings(rows, scratch, 16)
    found = Postings(spark, scratch).candidates("needle")
    assert [r["doc_id"] for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*(In|EqualTo)\(trigram", plan)


def test_required_words():
    assert required("(?i)the|der") == ["the", "der"] and required("colou?r|gray") == ["colo", "gray"]
    assert required("a.c|x") == ["a", "x"] and required("(a|b)") is None and required(".*|the") is None and required("a*") is None


# --- batch sinks -------------------------------------------------------------------------------------


def batch_of(spark, *ids):
    return spark.createDataFrame([(i, datetime(2024, 1, 1), "text", "s") for i in ids], "doc_id string, created_at timestamp, modality string, source string")


def test_a_batch_is_written_once(spark, scratch, monkeypatch):
    monkeypatch.setattr(inc, "DOCUMENT", None)
    sink = inc.BatchSink(f"{scratch}/t", f"{scratch}/c")
    held = lambda: sorted(r["doc_id"] for r in t.read_table(spark, f"{scratch}/t").collect())
    sink(batch_of(spark, "a", "b"), 0)
    sink(batch_of(spark, "a", "b"), 0)
    sink(batch_of(spark, "c"), 1)
    assert held() == ["a", "b", "c"]
    # A batch that broke off after some rows came in.
    sink._marked(spark, "2.begun", make=True)
    t.write_table(batch_of(spark, "d"), f"{scratch}/t")
    sink(batch_of(spark, "d", "e"), 2)
    assert held() == ["a", "b", "c", "d", "e"]
    # A new checkpoint knows nothing of the table, in any batch.
    other = inc.BatchSink(f"{scratch}/t", f"{scratch}/c2")
    other(batch_of(spark, "a", "f"), 0)
    other(batch_of(spark, "e", "g"), 1)
    assert held() == ["a", "b", "c", "d", "e", "f", "g"]


def test_stream_keeps_ids_in_state(spark, tmp_path):
    files, out, mark = tmp_path / "files", str(tmp_path / "out"), str(tmp_path / "mark")
    files.mkdir()
    for n in range(5):
        Path(files, f"f{n}.txt").write_text(f"text {n}")
    read = []

    def run(batch_files=2):
        query = inc.ingest_stream(spark, str(files), out, mark, files_per_batch=batch_files)
        query.awaitTermination()
        read.append(query.lastProgress["stateOperators"] if query.lastProgress else [])
        return t.read_table(spark, out).count()

    assert run() == 5
    assert sum(o["numRowsTotal"] for o in read[0]) == 5
    Path(files, "f5.txt").write_text("text 5")
    assert run() == 6 and run() == 6
    # The same uri written anew is a file that was not seen, with an id that was.
    Path(files, "f1.txt").write_text("text 1, longer")
    assert run() == 6


# --- contexts in SQL ---------------------------------------------------------------------------------


def test_contexts_equal_the_operator(spark):
    made = [(q, f"file:///x/{q}{n}.txt" if n % 5 else None, "s" if n % 7 else None, None if n == 3 else "w" * (40 * n % 300), round(1 - (n // 2) / 10, 3), n / 20, str(n)) for q in ("a", "b") for n in range(12)]
    made += [("c", "u/x", "s", "long " * 500, 0.9, 0.1, "1")]
    hits = spark.createDataFrame(made, "query_id string, uri string, source string, text_content string, relevance_score double, distance double, doc_id string").repartition(3)
    hits.createOrReplaceTempView("made_hits")
    register_sql(spark, spark.createDataFrame([], "doc_id string, uri string, source string, modality string, created_at timestamp, author string, channel string, text_content string, meta string, embedding array<double>"))
    for budget in (10, 60, 100, 150, 1000):
        want = {r["query_id"]: r["context"] for r in a.rag_context(hits, budget).collect()}
        got = spark.sql(f"SELECT * FROM fill_context(TABLE(made_hits) PARTITION BY query_id ORDER BY (relevance_score DESC, distance, doc_id), {budget})").collect()
        assert {r["query_id"]: r["context"] for r in got} == want, budget
        assert all(r["used_tokens"] <= budget for r in got)
    assert spark.sql("SELECT * FROM get_rag_context(array(1D), 100D)").count() == 0


# --- exports of any size -----------------------------------------------------------------------------


def test_large_exports_are_numbered_over_tasks(spark, tmp_path):
    made = [(f"d{n:04d}", "u", "s", "text", (n * 37 % 100) / 100, None, "t") for n in range(1000)]
    df = spark.createDataFrame(made, "doc_id string, uri string, source string, modality string, distance double, rel_score double, text_content string").repartition(5)
    want = [r[0] for r in sorted(made, key=lambda r: (r[4], r[0]))]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t.export_results(df, str(tmp_path / "csv"), one_file=100)
        t.export_results(df, str(tmp_path / "json"), "json", one_file=100)
        got = {int(r["rank"]): r["doc_id"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()}
        assert [got[n + 1] for n in range(1000)] == want and len(got) == 1000
        files = sorted(p for p in (tmp_path / "json").iterdir() if p.name.startswith("part-"))
        lines = [line for p in files for line in p.read_text().splitlines()]
        assert len(files) > 1 and [__import__("json").loads(line)["doc_id"] for line in lines] == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


# --- reports kept by day -----------------------------------------------------------------------------


def test_daily_reports_equal_a_scan(spark, scratch):
    day = datetime(2024, 1, 1)
    made = [
        (f"d{n}", f"u{n % 23}" if n % 11 else None, ["text", "pdf", None][n % 3], f"s{n % 2}", None if n % 7 == 0 else "x" * (n % 13),
         day + timedelta(days=n % 5) if n % 19 else None, [None, [], [1.0, 2.0]][n % 3])
        for n in range(120)
    ]
    df = spark.createDataFrame(made, "doc_id string, uri string, modality string, source string, text_content string, created_at timestamp, embedding array<double>")
    path = f"{scratch}/t"
    late = F.col("doc_id").isin("d6", "d11")
    t.write_table(df.where(~late), path)
    daily = DailyReports(spark, path, f"{scratch}/r")

    def same():
        rows = t.read_table(spark, path)
        for name in ("modality_stats", "document_stats", "embedding_stats", "corpus_totals"):
            want = values(getattr(quality, name)(rows), *getattr(quality, name)(rows).columns)
            got = getattr(daily, name)()
            assert values(got, *getattr(quality, name)(rows).columns) == want, name

    assert len(daily.refresh()) == 6 and daily.refresh() == []
    same()
    append_days(df.where(late), path)
    assert [d.isoformat() for d in daily.refresh()] == ["2024-01-02"]
    same()
    update_days(spark, path, c.clear_embeddings, F.col("doc_id") == "d5")
    update_days(spark, path, lambda rows: rows.where("false"), F.col("doc_id") == "d3")
    assert len(daily.refresh()) == 2
    same()


def test_postings_keep_a_trigram_once_for_many_texts(spark, scratch):
    texts = ["same words here", "same words there", "a\0", "a", "\U0001f600\U0001f600x", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text_content string").coalesce(1)
    build_postings(rows, scratch, 2)
    held = spark.read.parquet(f"{scratch}/postings").collect()
    want = {}
    for i, t in enumerate(texts):
        for run in {t[j:j + 3] for j in range(len(t) - 2)} if t and len(t) > 2 else [] if t is None else [t]:
            want.setdefault(run, []).append(i)
    assert len(held) == len(want) and {r["trigram"]: sorted(r["ids"]) for r in held} == want
    assert {r["trigram"]: r["docs"] for r in spark.read.parquet(f"{scratch}/trigrams").collect()} == {t: len(x) for t, x in want.items()}


def test_reports_have_no_folder_for_each_day(spark, scratch):
    """A refresh writes few files however many days it sums, and days that are summed again count once."""
    days = spark.range(40).select(
        F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("u"), "id").alias("uri"), F.lit("text").alias("modality"),
        F.lit("web").alias("source"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("created_at"),
        F.lit("words").alias("text_content"), F.array(F.lit(1.0)).alias("embedding"),
    )
    path = f"{scratch}/t"
    t.write_table(days, path)
    daily = DailyReports(spark, path, f"{scratch}/r")
    assert len(daily.refresh()) == 40 and daily.refresh() == []
    assert not [p for p in Path(scratch, "r").rglob("created_date=*")]
    append_days(days.where("doc_id < 10").withColumn("uri", F.concat("uri", F.lit("b"))), path)
    assert len(daily.refresh()) == 10
    row = daily.modality_stats().first()
    assert (row["document_count"], row["unique_files"]) == (50, 50) and daily.embedding_stats().first()["total_documents"] == 50
