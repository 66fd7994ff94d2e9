"""Ingest, corpus update and table queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.operators import corpus as c, ingest as g, media as m, quality
from semcorpus.plans import inputs as i
from semcorpus.plans.inputs import ANNOTATIONS, CORPUS, DOCS, NOW, OBJECTS, SEEN
from semcorpus.plans.registry import query
from semcorpus.sources import objects as o, tables
from semcorpus.sources.schemas import DOCUMENT, SIDE_TABLES, conform
from semcorpus.streaming.incremental import ingest_stream

_META = """'{"size":' || size || ',"last_modified":"' || strftime(updated, '%Y-%m-%dT%H:%M:%S.000Z')
    || '","generation":null}'"""


def _doc(modality: str, source: str, text: str, seen: bool = True) -> str:
    skip = "WHERE o.uri NOT IN (SELECT uri FROM seen)" if seen else ""
    return f"""SELECT md5(o.uri) AS doc_id, o.uri, '{modality}' AS modality, '{source}' AS source,
    '2024-06-01 00:00:00' AS created, {text} AS text_content, content_type AS mime_type, {_META} AS meta
    FROM objects o {skip}"""


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "uri", "modality", "source", i.stamp("created_at").alias("created"), "text_content", "mime_type", "meta"
    )


BASE = f"WITH {OBJECTS}, {SEEN} "


@query("classify", """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '\\.[^./]+$', 0)) AS ext FROM pages
    UNION ALL SELECT doc_id, 'file:///corpus/' || source || '/' || doc_id
    || ['.txt','.md','.pdf','.jpg'][doc_id % 4 + 1], ['.txt','.md','.pdf','.jpg'][doc_id % 4 + 1] FROM documents)
    SELECT url AS uri, CASE ext WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.pdf' THEN 'pdf'
    WHEN '.jpg' THEN 'images' END AS modality, CASE ext WHEN '.txt' THEN 'file' WHEN '.md' THEN 'markdown'
    WHEN '.pdf' THEN 'pdf' WHEN '.jpg' THEN 'screenshot' END AS source FROM u""")
def classify(spark, sf):
    urls = i.table(spark, sf, "pages").select(F.col("url").alias("uri"))
    return o.classify(urls.unionByName(i.documents(spark, sf).select("uri")))


@query("ingest_text", BASE + _doc("text", "file", "text"))
def ingest_text(spark, sf):
    return shown(g.ingest_text(i.objects(spark, sf), i.seen(spark, sf, "text", "file"), NOW))


@query("ingest_markdown", BASE + _doc("text", "markdown", "text"))
def ingest_markdown(spark, sf):
    return shown(g.ingest_markdown(i.objects(spark, sf), i.seen(spark, sf, "text", "markdown"), NOW))


@query("ingest_csv", BASE + _doc("csv", "csv", "text"))
def ingest_csv(spark, sf):
    return shown(g.ingest_csv(i.objects(spark, sf), i.seen(spark, sf, "csv", "csv"), NOW))


@query("ingest_office", BASE + _doc("document", "document", "text"))
def ingest_office(spark, sf):
    return shown(g.ingest_office(i.objects(spark, sf), i.seen(spark, sf, "document", "document"), NOW))


@query("ingest_pdf_raw", BASE + _doc("pdf", "pdf", "text"))
def ingest_pdf_raw(spark, sf):
    return shown(g.ingest_pdf_raw(i.objects(spark, sf), i.seen(spark, sf, "pdf", "pdf"), NOW))


def _json_objects(spark, sf):
    e = i.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("file:///events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("uri"),
        F.octet_length("props").cast("long").alias("size"), F.lit("application/json").alias("content_type"),
        F.col("ts").cast("timestamp").alias("updated"), F.lit(None).cast("string").alias("generation"),
        F.encode("props", "utf-8").alias("data"),
    )


@query("ingest_json", """SELECT md5('file:///events/' || event_id || '.json') AS doc_id,
    'file:///events/' || event_id || '.json' AS uri, 'json' AS modality, 'json' AS source,
    replace(CAST(CAST(props AS JSON) AS VARCHAR), ' ', '') AS text_content FROM events""")
def ingest_json(spark, sf):
    return g.ingest_json(_json_objects(spark, sf), None, NOW).select(
        "doc_id", "uri", "modality", "source", "text_content"
    )


@query("summarize_json", """SELECT 'file:///events/' || event_id || '.json' AS uri,
    'JSON File: ' || event_id || '.json' || chr(10) || 'Location: file:///events/' || event_id || '.json' || chr(10)
    || 'Type: JSON Document' || chr(10) || chr(10) || 'Root type: Object with ' || len(json_keys(props)) || ' keys'
    || chr(10) || 'Keys: ' || array_to_string(json_keys(props), ', ') || chr(10) || chr(10) || 'Sample content:'
    || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  ' || k || ': '
        || json_extract_string(props, '$.' || k)), chr(10)) || chr(10) || chr(10) || 'Data preview:' || chr(10)
    || replace(props, ' ', '') AS summary FROM events""")
def summarize_json(spark, sf):
    docs = g.ingest_json(_json_objects(spark, sf), None, NOW)
    return g.summarize_json(docs).select("uri", "summary")


def _csv_texts(spark, sf):
    """One CSV text per order, from its line items."""
    li = i.table(spark, sf, "lineitem")
    line = F.concat_ws(
        ",", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"),
        F.concat(F.lit('"'), F.col("l_quantity").cast("int").cast("string"), F.lit(', each"')),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), line.alias("line"))
    rows = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"])
    return li.groupBy("l_orderkey").agg(
        F.concat(F.lit("line,part,supplier,flag,status,quantity\n"), F.array_join(rows, "\n")).alias("text_content")
    ).select(
        F.concat(F.lit("file:///orders/"), F.col("l_orderkey").cast("string"), F.lit(".csv")).alias("uri"), "text_content"
    )


@query("summarize_csv", """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) AS n,
    l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_returnflag || ',' || l_linestatus || ',"'
        || CAST(l_quantity AS INT) || ', each"' AS line,
    'line:' || l_linenumber || ' | part:' || l_partkey || ' | supplier:' || l_suppkey || ' | flag:' || l_returnflag
        || ' | status:' || l_linestatus AS cells FROM lineitem)
    SELECT 'file:///orders/' || l_orderkey || '.csv' AS uri,
    'CSV File: ' || l_orderkey || '.csv' || chr(10) || 'Location: file:///orders/' || l_orderkey || '.csv' || chr(10)
    || 'Type: CSV Spreadsheet' || chr(10) || chr(10)
    || 'Columns (6): line, part, supplier, flag, status, quantity' || chr(10)
    || 'Rows: ' || count(*) || chr(10) || chr(10) || 'Sample data (first 5 rows):' || chr(10)
    || string_agg('  Row ' || n || ': ' || cells, chr(10) ORDER BY n) FILTER (n <= 5) || chr(10) || chr(10)
    || 'Data preview:' || chr(10) || 'line,part,supplier,flag,status,quantity' || chr(10)
    || string_agg(line, chr(10) ORDER BY n) FILTER (n <= 29) AS summary FROM l GROUP BY l_orderkey""")
def summarize_csv(spark, sf):
    return g.summarize_csv(_csv_texts(spark, sf)).select("uri", "summary")


def _stub(title, note):
    return f"""'{title} file: ' || regexp_extract(o.uri, '([^/]+)$', 1) || chr(10) || 'Type: ' || content_type
    || chr(10) || 'Size: ' || size || ' bytes' || chr(10) || 'Note: {note}'"""


@query("ingest_media_stubs", BASE + " UNION ALL ".join([
    _doc("image", "screenshot", _stub("Image", "OCR text extraction requires ML model configuration")),
    _doc("audio", "recording", _stub("Audio", "Audio transcription requires ML model configuration")),
    _doc("video", "video", _stub("Video", "Video transcription requires ML model configuration")),
]))
def ingest_media_stubs(spark, sf):
    objs = i.objects(spark, sf)
    made = [
        g.ingest_media_stub(objs, kind, i.seen(spark, sf, modality, source), NOW)
        for kind, modality, source in (
            ("images", "image", "screenshot"), ("audio", "audio", "recording"), ("video", "video", "video")
        )
    ]
    return shown(reduce(DataFrame.unionByName, made))


_NAME = "regexp_extract(o.uri, '/([^/]+)$', 1)"
_PDF = f"""'PDF Document: ' || coalesce(a.title, {_NAME}) || chr(10) || chr(10) || 'Description: '
    || coalesce(a.description, 'PDF document awaiting content extraction') || chr(10) || chr(10) || 'Category: '
    || coalesce(a.category, 'general') || chr(10) || 'Tags: ' || coalesce(a.tags, 'pdf, document') || chr(10)
    || 'Format: PDF' || chr(10) || 'Size: ' || size || ' bytes' || chr(10)
    || 'Note: Full text extraction requires Document AI or OCR processing'"""
_PDF_SQL = f"""SELECT md5(o.uri) AS doc_id, o.uri, 'pdf' AS modality, 'pdf' AS source,
    '2024-06-01 00:00:00' AS created, {_PDF} AS text_content, content_type AS mime_type, {_META} AS meta
    FROM objects o LEFT JOIN annotations a ON a.uri = o.uri WHERE o.uri NOT IN (SELECT uri FROM seen)"""


@query("ingest_pdf_annotated", BASE + f", {ANNOTATIONS} " + _PDF_SQL)
def ingest_pdf_annotated(spark, sf):
    return shown(g.ingest_pdf_annotated(
        i.objects(spark, sf), i.annotations(spark, sf), i.seen(spark, sf, "pdf", "pdf"), NOW
    ))


_FORMAT = "upper(regexp_extract(o.uri, '\\.([^.]+)$', 1))"
_IMAGE_SQL = f"""SELECT md5(o.uri) AS doc_id, o.uri, 'image' AS modality, 'image' AS source,
    '2024-06-01 00:00:00' AS created, coalesce('Image: ' || {_NAME} || chr(10) || chr(10) || 'Description: '
    || a.description || chr(10) || chr(10) || 'Tags: ' || a.tags || chr(10) || 'Format: ' || {_FORMAT} || chr(10)
    || 'Size: ' || size || ' bytes', 'Image File: ' || {_NAME} || chr(10) || 'Format: ' || {_FORMAT} || chr(10)
    || 'Size: ' || size || ' bytes' || chr(10) || 'Type: Stock photo or general image') AS text_content,
    content_type AS mime_type, {_META} AS meta FROM objects o LEFT JOIN annotations a ON a.uri = o.uri"""


@query("ingest_image_annotated", BASE + f", {ANNOTATIONS} " + _IMAGE_SQL)
def ingest_image_annotated(spark, sf):
    return shown(g.ingest_image_annotated(i.objects(spark, sf), i.annotations(spark, sf), None, NOW))


@query("run_stats", BASE + f""", {ANNOTATIONS}, d AS ({_doc("text", "file", "text")} UNION ALL {_PDF_SQL}
    UNION ALL {_IMAGE_SQL}) SELECT modality, count(*) AS documents,
    CAST(count(*) FILTER (text_content IS NULL) AS BIGINT) AS errors, count(DISTINCT uri) AS files
    FROM d GROUP BY ROLLUP (modality)""")
def run_stats(spark, sf):
    objs, notes = i.objects(spark, sf), i.annotations(spark, sf)
    made = [
        g.ingest_text(objs, i.seen(spark, sf, "text", "file"), NOW),
        g.ingest_pdf_annotated(objs, notes, i.seen(spark, sf, "pdf", "pdf"), NOW),
        g.ingest_image_annotated(objs, notes, None, NOW),
    ]
    return quality.run_stats(reduce(DataFrame.unionByName, made))


# The text of a document as its extracted text, by doc_id of the ingested pdf.
_EXTRACTED = """CASE WHEN length(d.text) > 3000 THEN substr(d.text, 1, 3000) || '...[truncated]' ELSE d.text END"""


def _pdfs(spark, sf):
    return g.ingest_pdf_annotated(i.objects(spark, sf), i.annotations(spark, sf), None, NOW)


def _extracted(spark, sf):
    """Extracted texts of the labelled documents."""
    lab = i.table(spark, sf, "labels").select("doc_id")
    d = i.table(spark, sf, "documents").join(lab, "doc_id")
    return d.select(
        F.md5(i.doc_uri(F.col("doc_id"), F.col("source"))).alias("doc_id"), F.col("text").alias("extracted_text")
    )


_APPLIED = f"""applied AS (SELECT md5(o.uri) AS doc_id, o.uri, CASE WHEN l.doc_id IS NOT NULL THEN
    substr({_PDF}, 1, length({_PDF}) - length('Note: Full text extraction requires Document AI or OCR processing'))
    || chr(10) || chr(10) || 'Extracted Text:' || chr(10) || {_EXTRACTED} ELSE {_PDF} END AS text_content
    FROM objects o LEFT JOIN annotations a ON a.uri = o.uri LEFT JOIN labels l ON l.doc_id = o.doc_id
    LEFT JOIN documents d ON d.doc_id = o.doc_id)"""


@query("apply_extraction", f"WITH {OBJECTS}, {ANNOTATIONS}, {_APPLIED} SELECT * FROM applied")
def apply_extraction(spark, sf):
    done = g.apply_extraction(_pdfs(spark, sf), _extracted(spark, sf), 3000)
    return done.select("doc_id", "uri", "text_content")


@query("pending_extraction", f"""WITH {OBJECTS}, {ANNOTATIONS}, {_APPLIED} SELECT uri, doc_id FROM applied
    WHERE NOT contains(lower(text_content), 'extracted text:')""")
def pending_extraction(spark, sf):
    return g.pending_extraction(g.apply_extraction(_pdfs(spark, sf), _extracted(spark, sf), 3000))


@query("sync_text", f"""WITH {OBJECTS}, {ANNOTATIONS}, {_APPLIED} SELECT doc_id, text_content FROM applied""")
def sync_text(spark, sf):
    pdfs = _pdfs(spark, sf)
    done = g.apply_extraction(pdfs, _extracted(spark, sf), 3000)
    return c.sync_text(pdfs, done).select("doc_id", "text_content")


@query("choose_extraction", f"""WITH x AS (SELECT {i._URI} AS uri, d.doc_id AS pages,
    CASE d.doc_id % 3 WHEN 0 THEN d.text WHEN 1 THEN '[No text extracted]' END AS a,
    CASE WHEN d.doc_id % 2 = 0 THEN d.text END AS b FROM documents d),
    y AS (SELECT *, CASE WHEN length(a) > 0 AND NOT contains(a, '[No text extracted]') THEN 'primary'
    WHEN length(b) > 0 AND NOT contains(b, '[No text extracted]') THEN 'fallback' ELSE 'metadata' END AS method FROM x),
    z AS (SELECT *, CASE method WHEN 'primary' THEN a WHEN 'fallback' THEN b END AS t,
    CASE method WHEN 'primary' THEN 'Document AI (OCR)' ELSE 'PyPDF2' END AS via FROM y)
    SELECT uri, method, CASE WHEN method = 'metadata' THEN 'PDF Document: ' || regexp_extract(uri, '([^/]+)$', 1)
    || chr(10) || 'Location: ' || uri || chr(10) || chr(10)
    || 'Note: Full text extraction failed; indexed with metadata only.' ELSE
    'PDF File: ' || regexp_extract(uri, '([^/]+)$', 1) || chr(10) || 'Location: ' || uri || chr(10) || 'Pages: '
    || pages || chr(10) || 'Extraction Method: ' || via || chr(10) || chr(10) || 'Content:' || chr(10)
    || replace(substr(t, 1, 3000), chr(10) || chr(10) || chr(10), chr(10) || chr(10))
    || CASE WHEN length(t) > 3000 THEN chr(10) || '... [Document contains ' || length(t) || ' characters total]'
    ELSE '' END || chr(10) || chr(10) || 'Analysis: ' || via || ' extraction complete' END AS text_content FROM z""")
def choose_extraction(spark, sf):
    d = i.table(spark, sf, "documents")
    n, text = F.col("doc_id"), F.col("text")
    both = d.select(
        i.doc_uri(n, F.col("source")).alias("uri"), n.alias("pages"),
        F.when(n % 3 == 0, text).when(n % 3 == 1, g.NO_TEXT).alias("primary_text"),
        F.when(n % 2 == 0, text).alias("fallback_text"),
    )
    return g.choose_extraction(both).select("uri", "method", "text_content")


# --- corpus updates ----------------------------------------------------------------------------------


def _labelled(spark, sf):
    """The corpus rows that carry a label."""
    lab = i.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return i.corpus(spark, sf).join(lab, "doc_id", "left_semi")


@query("add_missing", f"""WITH {DOCS} SELECT doc_id, uri, modality FROM docs WHERE modality IN ('pdf', 'image')
    AND n NOT IN (SELECT doc_id FROM labels)""")
def add_missing(spark, sf):
    """By doc_id for pdf rows, by uri for image rows."""
    docs, held = i.documents(spark, sf), _labelled(spark, sf)
    pdf = c.add_missing(held, docs, "pdf")
    image = c.add_missing(held, docs, "image", "uri")
    return pdf.unionByName(image).select("doc_id", "uri", "modality")


@query("new_files", f"WITH {OBJECTS}, {SEEN} SELECT uri FROM objects EXCEPT SELECT uri FROM seen")
def new_files(spark, sf):
    return m.new_files(i.objects(spark, sf).select("uri"), i.seen(spark, sf, "video", "video"))


@query("distinct_uris", "SELECT DISTINCT 'file:///user/' || user_id AS uri FROM events")
def distinct_uris(spark, sf):
    e = i.table(spark, sf, "events")
    return g.distinct_uris(e.select(F.concat(F.lit("file:///user/"), F.col("user_id").cast("string")).alias("uri")))


@query("replace_text", f"""WITH {CORPUS} SELECT c.doc_id,
    CASE WHEN l.doc_id IS NOT NULL THEN 'label ' || l.quality ELSE text_content END AS text_content,
    l.doc_id IS NULL AND embedding IS NOT NULL AS has_vector
    FROM corpus c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.doc_id""")
def replace_text(spark, sf):
    rows = i.corpus(spark, sf)
    lab = i.table(spark, sf, "labels")
    texts = lab.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("t")
    ).join(i.documents(spark, sf).select("doc_id", "uri"), "doc_id").select("uri", F.col("t").alias("text_content"))
    return c.replace_text(rows, texts).select(
        "doc_id", "text_content", F.col("embedding").isNotNull().alias("has_vector")
    )


_DESCRIBED = f"""described AS (SELECT c.doc_id, c.modality, CASE WHEN a.uri IS NOT NULL AND c.modality = 'image' THEN
    'Image: ' || regexp_extract(o.uri, '/([^/]+)$', 1) || chr(10) || chr(10) || 'Description: ' || a.description
    || chr(10) || chr(10) || 'Tags: ' || coalesce(a.tags, 'none') || chr(10) || 'Format: ' || {_FORMAT} || chr(10)
    || 'Size: ' || size || ' bytes' || chr(10) || 'Type: ' || content_type || chr(10) || chr(10)
    || 'Indexed: 2024-06-01' ELSE c.text_content END AS text_content
    FROM docs c JOIN objects o ON o.uri = c.uri LEFT JOIN annotations a ON a.uri = c.uri)"""


def _described(spark, sf):
    notes = i.annotations(spark, sf).withColumn("tags", F.coalesce("tags", F.array(F.lit("none"))))
    return c.describe_images(i.documents(spark, sf), notes, i.objects(spark, sf), F.lit("2024-06-01"))


@query("describe_images", f"WITH {DOCS}, {OBJECTS}, {ANNOTATIONS}, {_DESCRIBED} SELECT doc_id, text_content FROM described")
def describe_images(spark, sf):
    return _described(spark, sf).select("doc_id", "text_content")


@query("description_coverage", f"""WITH {DOCS}, {OBJECTS}, {ANNOTATIONS}, {_DESCRIBED}, t AS (SELECT count(*) AS total,
    count(*) FILTER (contains(text_content, 'Description:')) AS w FROM described WHERE modality = 'image')
    SELECT total, w AS with_descriptions, total - w AS without_descriptions, round(w / total * 100, 6) AS percent FROM t""")
def description_coverage(spark, sf):
    return quality.description_coverage(_described(spark, sf)).withColumn("percent", F.round("percent", 6))


# --- tables ------------------------------------------------------------------------------------------


@query("check_contract", f"""WITH {CORPUS} SELECT * FROM (VALUES
    ('doc_id', true), ('uri', true), ('modality', true), ('source', true), ('created_at', true), ('author', false),
    ('channel', false), ('text_content', false), ('mime_type', false), ('meta', false), ('chunk_index', false),
    ('chunk_start', false), ('chunk_end', false), ('embedding', false)) v(column_name, required),
    LATERAL (SELECT column_name NOT LIKE 'chunk%' AS present, column_name NOT LIKE 'chunk%' AS type_ok,
    column_name NOT LIKE 'chunk%' AS ok, CASE WHEN column_name IN ('author', 'channel') OR column_name LIKE 'chunk%'
    THEN (SELECT count(*) FROM corpus) WHEN column_name = 'embedding'
    THEN (SELECT count(*) FROM corpus WHERE embedding IS NULL) ELSE 0 END AS null_rows)""")
def check_contract(spark, sf):
    return tables.check_contract(i.corpus(spark, sf), DOCUMENT)


@query("copied_table", f"""WITH {CORPUS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, modality, count(*) AS rows,
    CAST(sum(length(text_content)) AS BIGINT) AS chars, count(embedding) AS vectors FROM corpus GROUP BY 1, 2""")
def copied_table(spark, sf):
    """Create the tables, append the corpus, copy it, read the copy by day."""
    root = i.work_dir(spark)
    tables.create_tables(spark, root)
    tables.write_table(tables.conform(i.corpus(spark, sf), DOCUMENT), f"{root}/search_corpus")
    tables.copy_dataset(spark, f"{root}/search_corpus", f"{root}/copy")
    rows = tables.read_table(spark, f"{root}/copy", DOCUMENT)
    return rows.groupBy(F.col("created_date").cast("string").alias("day"), "modality").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text_content")).alias("chars"),
        F.count("embedding").alias("vectors"),
    )


# Each text becomes a line of a file, so a file holds its texts and one line end per text.
_FILE_CHARS = "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source"


def _write_files(spark, sf) -> str:
    """The documents as text files of up to 50 texts, one folder per source."""
    path = i.work_dir(spark) + "/files"
    i.table(spark, sf, "documents").select("source", "text").write.option("maxRecordsPerFile", 50).partitionBy(
        "source"
    ).text(path)
    return path


def _chars_by_source(docs):
    source = F.regexp_extract("uri", "source=([^/]+)", 1)
    return docs.groupBy(source.alias("source")).agg(F.sum(F.length("text_content")).alias("chars"))


@query("file_documents", _FILE_CHARS)
def file_documents(spark, sf):
    """Files listed, classified by extension and read into documents."""
    return _chars_by_source(g.build_documents(spark, _write_files(spark, sf), ["text", "markdown"], now=NOW))


@query("file_stream", _FILE_CHARS)
def file_stream(spark, sf):
    """The same files as a stream, run twice: the second run finds no new file."""
    path = _write_files(spark, sf)
    root = i.work_dir(spark)
    for _ in range(2):
        ingest_stream(spark, path, f"{root}/documents", f"{root}/checkpoint").awaitTermination()
    return _chars_by_source(tables.read_table(spark, f"{root}/documents", DOCUMENT))


@query("side_tables", f"""WITH {ANNOTATIONS} SELECT coalesce(category, 'none') AS category, count(*) AS rows,
    count(DISTINCT uri) AS uris, count(title) AS titles, count(tags) AS tagged FROM annotations GROUP BY 1""")
def side_tables(spark, sf):
    """The side tables created empty, annotations appended to theirs, and the table read back."""
    root = i.work_dir(spark)
    tables.create_side_tables(spark, root)
    schema, order = SIDE_TABLES["pdf_metadata"]
    rows = i.annotations(spark, sf).withColumns({"pdf_id": F.md5("uri"), "created_at": F.lit(NOW)})
    tables.write_table(conform(rows, schema), f"{root}/pdf_metadata", sort_by=order)
    back = tables.read_table(spark, f"{root}/pdf_metadata", schema)
    return back.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("uri").alias("uris"), F.count("title").alias("titles"),
        F.count("tags").alias("tagged"),
    )


@query("loaded_json", "SELECT CAST(event_id AS VARCHAR) AS doc_id, event_type AS source FROM events")
def loaded_json(spark, sf):
    """Events written as JSON lines, read back under the document schema: other fields are ignored."""
    path = i.work_dir(spark) + "/json"
    e = i.table(spark, sf, "events")
    e.withColumns({"doc_id": F.col("event_id").cast("string"), "source": F.col("event_type")}).write.json(path)
    return tables.load_json_rows(spark, path, DOCUMENT).select("doc_id", "source")
