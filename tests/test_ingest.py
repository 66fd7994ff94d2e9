import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from semcorpus import Settings
from semcorpus.operators import ingest as g
from semcorpus.operators import quality as q
from semcorpus.sources import objects as o
from semcorpus.sources import tables as t
from semcorpus.sources.schemas import CORE_TABLES, DOCUMENT, IMAGE_DESCRIPTIONS, SIDE_TABLES, conform
from semcorpus.streaming import incremental as inc

NOW = datetime(2024, 6, 1)
FILES = {
    "a.txt": b"plain text", "sub/b.log": b"a log", "bad.txt": b"\xff\xfe broken", "c.md": b"# head", "d.json": b'{"b": 1, "a": [true, null]}',
    "e.json": b"{not json", "f.csv": b'x,y\n1,"two, three"\n4,\n', "g.docx": b"office", "h.pdf": b"%PDF", "i.JPG": b"jpeg", "i.jpg": b"jpeg",
    "j.mp3": b"sound", "k.mp4": b"film", "other.xyz": b"?",
}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "files"
    for name, data in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(base)


def by_name(df):
    return {r["uri"].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_listing_by_modality(spark, root):
    assert sorted(by_name(o.scan_objects(spark, root, "text", content=False))) == ["a.txt", "b.log", "bad.txt"]
    got = by_name(o.classify(o.scan_objects(spark, root)))
    assert got["other.xyz"]["modality"] is None and got["i.JPG"]["modality"] == "images"
    assert (got["k.mp4"]["source"], got["k.mp4"]["content_type"], got["k.mp4"]["size"]) == ("video", "video/mp4", 4)


def test_all_modalities_in_one_table(spark, root):
    docs = by_name(g.build_documents(spark, root, now=NOW))
    assert len(docs) == 12 and "other.xyz" not in docs
    assert docs["bad.txt"]["text_content"] is None and docs["a.txt"]["text_content"] == "plain text"
    assert docs["d.json"]["text_content"] == '{"a":[true,null],"b":1}' and docs["e.json"]["text_content"] is None
    assert docs["j.mp3"]["text_content"] == (
        "Audio file: j.mp3\nType: audio/mpeg\nSize: 5 bytes\nNote: Audio transcription requires ML model configuration"
    )
    assert (docs["c.md"]["modality"], docs["c.md"]["source"]) == ("text", "markdown")
    assert json.loads(docs["a.txt"]["meta"])["size"] == 10
    few = by_name(g.build_documents(spark, root, ["all"], no_video=True, no_audio=True, now=NOW))
    assert "k.mp4" not in few and "j.mp3" not in few
    with pytest.raises(ValueError):
        g.build_documents(spark, root, ["smell"])


def test_second_run_adds_nothing(spark, root):
    first = g.build_documents(spark, root, ["text", "json", "csv"], now=NOW)
    again = g.build_documents(spark, root, ["text", "json", "csv"], known=first, now=NOW)
    assert first.count() == 6 and again.count() == 0
    stats = {r["modality"]: (r["documents"], r["errors"]) for r in q.run_stats(first).collect()}
    assert stats == {"text": (3, 1), "json": (2, 1), "csv": (1, 0), None: (6, 2)}


def test_markdown_is_known_by_source(spark, root):
    held = spark.createDataFrame([("x", "text", "file")], "uri string, modality string, source string")
    objs = o.scan_objects(spark, root, "markdown")
    same = held.unionByName(objs.select("uri", F.lit("text").alias("modality"), F.lit("file").alias("source")))
    assert g.ingest_markdown(objs, same, NOW).count() == 1


def test_raw_variants(spark, root):
    raw = by_name(g.ingest_json(o.scan_objects(spark, root, "json"), None, NOW, raw=True))
    assert raw["e.json"]["text_content"] == "{not json" and raw["e.json"]["modality"] == "text"
    assert by_name(g.ingest_csv(o.scan_objects(spark, root, "csv"), None, NOW, raw=True))["f.csv"]["modality"] == "text"


def test_annotated_images_fall_back_on_any_null(spark, root):
    objs = o.scan_objects(spark, root, "images")
    uri = [r["uri"] for r in objs.select("uri").collect() if r["uri"].endswith("i.jpg")][0]
    notes = spark.createDataFrame([("1", uri, None, ["x"], NOW)], IMAGE_DESCRIPTIONS)
    assert by_name(g.ingest_image_annotated(objs, notes, None, NOW))["i.jpg"]["text_content"].startswith("Image File: ")
    notes = spark.createDataFrame([("1", uri, "a bird", ["x", "y"], NOW)], IMAGE_DESCRIPTIONS)
    assert by_name(g.ingest_image_annotated(objs, notes, None, NOW))["i.jpg"]["text_content"] == (
        "Image: i.jpg\n\nDescription: a bird\n\nTags: x, y\nFormat: JPG\nSize: 4 bytes"
    )


def docs(spark, texts):
    return spark.createDataFrame([(f"file:///x/{i}.f", x) for i, x in enumerate(texts)], "uri string, text_content string")


def test_json_summaries(spark):
    wide = json.dumps({f"k{i:02d}": i for i in range(25)})
    got = [r["summary"] for r in g.summarize_json(docs(spark, [
        '{"s": "v", "n": null, "b": true, "o": {"x": 1}, "f": 1.5}', '[{"a": 1}, 2]', "[]", "nope", wide, json.dumps(["x" * 3000])
    ])).orderBy("uri").collect()]
    assert "Root type: Object with 5 keys\nKeys: s, n, b, o, f\n\nSample content:\n  s: v\n  b: True\n  f: 1.5\n" in got[0]
    assert "Root type: Array with 2 items\nFirst item type: dict" in got[1]
    assert "Root type: Array with 0 items\n\nData preview:\n[]" in got[2]
    assert got[3] is None
    assert "Object with 25 keys" in got[4] and "k19" in got[4].split("Sample")[0] and "k20" not in got[4].split("Sample")[0]
    assert got[5].endswith("\n... [truncated]")


def test_csv_summaries(spark):
    body = 'a,b,c,d,e,f\n1,"x, y","say ""hi""","two\nlines",' + "z" * 30 + ",6\n" + "".join(f"{i},,,,,\n" for i in range(40))
    got = g.summarize_csv(docs(spark, [body])).first()["summary"]
    assert "Columns (6): a, b, c, d, e, f\nRows: 41\n" in got
    assert '  Row 1: a:1 | b:x, y | c:say "hi" | d:two\nlines | e:' + "z" * 20 + "\n  Row 2: a:0 | b:null" in got
    assert "Row 5" in got and "Row 6" not in got
    assert got.split("Data preview:\n")[1] == "\n".join(body.split("\n")[:30])


def test_csv_cells_keep_control_characters(spark):
    got = g.summarize_csv(docs(spark, ['a,b\nx\u0001y,p\u0002q\n"\u0001c,\u0001n","\u0001m\n\u0001"\n'])).first()["summary"]
    assert "Row 1: a:x\u0001y | b:p\u0002q" in got and "Row 2: a:\u0001c,\u0001n | b:\u0001m\n\u0001" in got


def test_empty_tables_keep_their_schema(spark, scratch):
    from semcorpus.sources import tables
    from semcorpus.sources.schemas import CORE_TABLES

    for name in tables.create_tables(spark, scratch, side=True):
        rows = tables.read_table(spark, f"{scratch}/{name}")
        assert rows.count() == 0 and "created_date" in rows.columns
    name, (schema, _) = next(iter(CORE_TABLES.items()))
    assert tables.read_table(spark, f"{scratch}/{name}").columns[:-1] == [f.name for f in schema.fields]


def test_extraction_is_cut_and_replaces_the_note(spark):
    d = spark.createDataFrame([("a", "pdf", "PDF\nNote: Full text extraction requires x", "u"), ("b", "pdf", "keep", "v")], "doc_id string, modality string, text_content string, uri string")
    ext = spark.createDataFrame([("a", "t" * 12), ("b", "")], "doc_id string, extracted_text string")
    got = {r["doc_id"]: r["text_content"] for r in g.apply_extraction(d, ext, 10).collect()}
    assert got == {"a": "PDF\n\n\nExtracted Text:\n" + "t" * 10 + "...[truncated]", "b": "keep"}
    done = g.apply_extraction(d, ext, 10)
    assert [r["doc_id"] for r in g.pending_extraction(done, 5).collect()] == ["b"]


# --- tables ------------------------------------------------------------------------------------------


def test_create_append_copy_and_check(spark, scratch):
    assert t.create_tables(spark, scratch, side=True) == sorted([*CORE_TABLES, *SIDE_TABLES])
    assert t.create_side_tables(spark, scratch) == sorted(SIDE_TABLES)
    path = f"{scratch}/documents"
    row = {"doc_id": "a", "uri": "u", "modality": "text", "source": "s", "created_at": NOW, "embedding": [1.0]}
    assert t.append_rows(spark, [row, {**row, "doc_id": "b", "created_at": datetime(2024, 6, 2)}], DOCUMENT, path, ["source"]) == 2
    back = t.read_table(spark, path, DOCUMENT)
    assert back.count() == 2 and t.on_days(back, NOW, NOW).count() == 1
    plan = t.on_days(back, NOW, None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    assert all(r["ok"] for r in t.check_contract(back, DOCUMENT).collect())
    bad = back.withColumn("uri", F.lit(None).cast("string")).drop("source")
    broken = {r["column_name"] for r in t.check_contract(bad, DOCUMENT).collect() if not r["ok"]}
    assert broken == {"uri", "source"}
    t.copy_dataset(spark, path, f"{scratch}/copy")
    assert t.read_table(spark, f"{scratch}/copy").count() == 2
    with pytest.raises(ValueError):
        t.copy_dataset(spark, path, path)
    assert t.missing_tables(spark, scratch) == [] and t.missing_tables(spark, scratch + "/no") == list(CORE_TABLES)


def test_json_rows_ignore_unknown_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"uri": "u", "title": "t", "zzz": 1}\n{"uri": "v", "tags": ["a"]}\n')
    df = t.load_json_rows(spark, str(tmp_path / "r.json"), SIDE_TABLES["pdf_metadata"][0])
    assert df.columns == SIDE_TABLES["pdf_metadata"][0].names and df.count() == 2


def test_exports(spark, tmp_path):
    rows = [("b", "u", "x", "text", 0.2, None, 'say "a", b\n' + "y" * 600), ("a", "u", "x", "text", 0.1, None, "t")]
    df = spark.createDataFrame(rows, "doc_id string, uri string, source string, modality string, distance double, rel_score double, text_content string")
    t.export_results(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').collect()
    assert [(r["rank"], r["doc_id"], r["score"]) for r in back] == [("1", "a", "0.1"), ("2", "b", "0.2")]
    assert len(back[1]["text_content"]) == 500
    t.export_results(df, str(tmp_path / "json"), "json")
    assert [r["doc_id"] for r in spark.read.json(str(tmp_path / "json")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        t.export_results(df, str(tmp_path / "x"), "xml")


# --- streams -----------------------------------------------------------------------------------------


def test_streams_see_each_file_once(spark, root, tmp_path):
    out, corpus = str(tmp_path / "documents"), str(tmp_path / "corpus")
    cfg = Settings(dim=16)

    def run(mark=""):
        inc.ingest_stream(spark, root, out, str(tmp_path / f"c1{mark}")).awaitTermination()
        inc.corpus_stream(spark, out, corpus, str(tmp_path / f"c2{mark}"), cfg).awaitTermination()
        return t.read_table(spark, out).count(), t.read_table(spark, corpus).count()

    assert run() == (3, 2)
    assert run() == (3, 2)
    Path(root, "new.txt").write_text("word " * 800)
    n = len(range(0, 4000, 800))
    assert run() == (4, 2 + n)
    # A lost checkpoint reads everything again and adds nothing.
    assert run("lost") == (4, 2 + n)
    rows = t.read_table(spark, corpus).where(F.col("embedding").isNull())
    assert rows.count() == 0


def test_conform_fills_and_casts(spark):
    df = conform(spark.createDataFrame([(1, 2.0)], "doc_id int, extra double"), DOCUMENT)
    assert df.columns == DOCUMENT.names and df.first()["doc_id"] == "1"
