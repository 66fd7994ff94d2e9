"""Object tables to documents.

Ids are md5(uri), so re-running an ingest gives the same rows. Every ingest skips uris already known.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcorpus.functions.text import extract, file_format, file_name, head, preview, to_text
from semcorpus.settings import MODALITY_EXTENSIONS
from semcorpus.sources.objects import scan_objects
from semcorpus.sources.schemas import DOCUMENT, conform

# The wording of generated document texts.
STUB_KINDS = {
    "images": ("image", "screenshot", "Image", "OCR text extraction requires ML model configuration"),
    "audio": ("audio", "recording", "Audio", "Audio transcription requires ML model configuration"),
    "video": ("video", "video", "Video", "Video transcription requires ML model configuration"),
}
NO_TEXT = "[No text extracted]"
EXTRACTED = "Extracted Text:"
TRUNCATED = "...[truncated]"


def skip_known(objects: DataFrame, known: DataFrame | None, key: str = "uri") -> DataFrame:
    """Objects whose key is not among the known rows; a NULL known key hides nothing."""
    if known is None:
        return objects
    seen = known.select(F.col(key)).where(F.col(key).isNotNull())
    return objects.join(seen, key, "left_anti")


def known_uris(documents: DataFrame | None, modality: str | None = None, source: str | None = None):
    """Uris already ingested under a modality or a source."""
    if documents is None:
        return None
    if modality is not None:
        documents = documents.where(F.col("modality") == modality)
    if source is not None:
        documents = documents.where(F.col("source") == source)
    return documents.select("uri")


def _stamp(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def _documents(objects: DataFrame, modality: str, source: str, text: Column, now: datetime | None) -> DataFrame:
    meta = F.to_json(
        F.struct("size", F.col("updated").alias("last_modified"), "generation"), {"ignoreNullFields": "false"}
    )
    return conform(
        objects.select(
            F.md5("uri").alias("doc_id"),
            "uri",
            F.lit(modality).alias("modality"),
            F.lit(source).alias("source"),
            _stamp(now).alias("created_at"),
            text.alias("text_content"),
            F.col("content_type").alias("mime_type"),
            meta.alias("meta"),
        ),
        DOCUMENT,
    )


def ingest_text(objects, known=None, now=None) -> DataFrame:
    fresh = skip_known(objects, known_uris(known, modality="text"))
    return _documents(fresh, "text", "file", to_text("data"), now)


def ingest_markdown(objects, known=None, now=None) -> DataFrame:
    fresh = skip_known(objects, known_uris(known, source="markdown"))
    return _documents(fresh, "text", "markdown", to_text("data"), now)


def canonical_json(text: Column) -> Column:
    """Re-serialised JSON with sorted keys; NULL when the text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def ingest_json(objects, known=None, now=None, raw: bool = False) -> DataFrame:
    """Canonical JSON text, or with raw the file's text under modality text."""
    if raw:
        fresh = skip_known(objects, known_uris(known, source="json"))
        return _documents(fresh, "text", "json", to_text("data"), now)
    fresh = skip_known(objects, known_uris(known, modality="json"))
    return _documents(fresh, "json", "json", canonical_json(to_text("data")), now)


def ingest_csv(objects, known=None, now=None, raw: bool = False) -> DataFrame:
    modality = "text" if raw else "csv"
    seen = known_uris(known, source="csv") if raw else known_uris(known, modality="csv")
    return _documents(skip_known(objects, seen), modality, "csv", to_text("data"), now)


def ingest_office(objects, known=None, now=None) -> DataFrame:
    fresh = skip_known(objects, known_uris(known, modality="document"))
    return _documents(fresh, "document", "document", to_text("data"), now)


def ingest_pdf_raw(objects, known=None, now=None) -> DataFrame:
    fresh = skip_known(objects, known_uris(known, modality="pdf"))
    return _documents(fresh, "pdf", "pdf", to_text("data"), now)


def ingest_media_stub(objects, kind: str, known=None, now=None) -> DataFrame:
    """Placeholder text for images, audio or video: name, type, size and a note."""
    modality, source, title, note = STUB_KINDS[kind]
    text = F.concat(
        F.lit(f"{title} file: "), F.element_at(F.split("uri", "/"), -1),
        F.lit("\nType: "), F.col("content_type"),
        F.lit("\nSize: "), F.col("size").cast("string"), F.lit(f" bytes\nNote: {note}"),
    )
    return _documents(skip_known(objects, known_uris(known, modality=modality)), modality, source, text, now)


def _last_part(uri: str) -> Column:
    return extract(uri, r"/([^/]+)$")


def ingest_pdf_annotated(objects, annotations, known=None, now=None) -> DataFrame:
    """Text from title, description, category and tags, each with a default."""
    a = annotations.select(
        "uri", F.col("title").alias("a_title"), F.col("description").alias("a_description"),
        F.col("category").alias("a_category"), F.col("tags").alias("a_tags"),
    )
    size = F.col("size").cast("string")
    full = F.concat(
        F.lit("PDF Document: "), F.coalesce("a_title", _last_part("uri")),
        F.lit("\n\nDescription: "),
        F.coalesce("a_description", F.lit("PDF document awaiting content extraction")),
        F.lit("\n\nCategory: "), F.coalesce("a_category", F.lit("general")),
        F.lit("\nTags: "), F.coalesce(F.array_join("a_tags", ", "), F.lit("pdf, document")),
        F.lit("\nFormat: PDF\nSize: "), size,
        F.lit(" bytes\nNote: Full text extraction requires Document AI or OCR processing"),
    )
    short = F.concat(
        F.lit("PDF File: "), _last_part("uri"), F.lit("\nFormat: PDF\nSize: "), size,
        F.lit(" bytes\nType: Portable Document Format\nNote: Awaiting content extraction"),
    )
    fresh = skip_known(objects, known_uris(known, modality="pdf")).join(a, "uri", "left")
    return _documents(fresh, "pdf", "pdf", F.coalesce(full, short), now)


def ingest_image_annotated(objects, descriptions, known=None, now=None) -> DataFrame:
    """Described images get the rich text; a NULL in any part selects the plain one."""
    d = descriptions.select(
        "uri", F.col("description").alias("d_description"), F.col("tags").alias("d_tags")
    )
    size = F.col("size").cast("string")
    rich = F.concat(
        F.lit("Image: "), _last_part("uri"),
        F.lit("\n\nDescription: "), F.col("d_description"),
        F.lit("\n\nTags: "), F.array_join("d_tags", ", "),
        F.lit("\nFormat: "), file_format("uri"),
        F.lit("\nSize: "), size, F.lit(" bytes"),
    )
    plain = F.concat(
        F.lit("Image File: "), _last_part("uri"), F.lit("\nFormat: "), file_format("uri"),
        F.lit("\nSize: "), size, F.lit(" bytes\nType: Stock photo or general image"),
    )
    fresh = skip_known(objects, known_uris(known, modality="image")).join(d, "uri", "left")
    return _documents(fresh, "image", "image", F.coalesce(rich, plain), now)


def _py_type(kind: Column) -> Column:
    """A JSON type under its Python name."""
    return (
        F.when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list")
        .when(kind == "STRING", "str").when(kind == "BIGINT", "int")
        .when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType").otherwise("float")
    )


def summarize_json(df: DataFrame, text: str = "text_content", indexed: Column | None = None) -> DataFrame:
    """Add summary: root type, up to 20 keys, up to 10 scalar samples, first item type, 2000-char preview."""
    # Each parse is a column of its own: inside a lambda it would run once per key.
    first = F.slice(F.map_entries("__members"), 1, 10)
    parsed = (
        df.withColumn("__whole", F.try_parse_json(text))
        .withColumn("__members", F.from_json(text, "map<string,variant>"))
        .withColumns({
            "__body": F.to_json("__whole"),
            "__items": F.json_array_length(text),
            "__first": F.transform(first, lambda e: F.struct(
                e["key"].alias("key"), _py_type(F.schema_of_variant(e["value"])).alias("kind"),
                e["value"].cast("string").alias("shown"),
            )),
        })
    )
    scalars = F.filter("__first", lambda e: e["kind"].isin("str", "int", "float", "bool"))

    def sample(e: Column) -> Column:
        shown = F.when(e["kind"] == "bool", F.initcap(e["shown"])).otherwise(e["shown"])
        return F.concat(F.lit("  "), e["key"], F.lit(": "), head(shown, 100))

    samples = F.concat_ws("\n", F.lit("\n\nSample content:"), F.transform(scalars, sample))
    keys = F.map_keys("__members")
    as_object = F.concat(
        F.lit("Root type: Object with "), F.size(keys).cast("string"), F.lit(" keys\nKeys: "),
        F.array_join(F.slice(keys, 1, 20), ", "), samples,
    )
    as_array = F.concat(
        F.lit("Root type: Array with "), F.col("__items").cast("string"), F.lit(" items"),
        F.when(
            F.col("__items") > 0,
            F.concat(
                F.lit("\nFirst item type: "),
                _py_type(F.schema_of_variant(F.try_variant_get("__whole", "$[0]", "variant"))),
            ),
        ).otherwise(""),
    )
    parts = [
        F.concat(F.lit("JSON File: "), file_name("uri")),
        F.concat(F.lit("Location: "), F.col("uri")),
        F.lit("Type: JSON Document\n"),
        F.when(F.col("__members").isNotNull(), as_object).when(F.col("__items").isNotNull(), as_array),
        F.concat(F.lit("\nData preview:\n"), preview("__body", 2000, "\n... [truncated]")),
        *([] if indexed is None else [F.concat(F.lit("\nIndexed: "), indexed)]),
    ]
    return parsed.withColumn("summary", F.when(F.col("__body").isNotNull(), F.concat_ws("\n", *parts))).drop(
        "__whole", "__members", "__body", "__items", "__first"
    )


# Stands before a letter that tells what is masked; a mark of the text itself is masked too, so nothing is mistaken.
_MARK = "\u0001"


def _csv_records(text: Column) -> Column:
    """Records of a CSV text, with the newlines and commas inside quotes masked; one pass over the text."""
    parts = F.split(text, '"')
    last = F.size(parts) - 1

    def part(p: Column, i: Column) -> Column:
        plain = F.replace(p, F.lit(_MARK), F.lit(_MARK + "m"))
        masked = F.replace(F.replace(plain, F.lit("\n"), F.lit(_MARK + "n")), F.lit(","), F.lit(_MARK + "c"))
        # Nothing between two quoted runs is a doubled quote.
        doubled = (p == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, masked).when(doubled, '"').otherwise(plain)

    joined = F.array_join(F.transform(parts, part), "")
    return F.filter(F.split(joined, "\r?\n"), lambda r: r != "")


def _csv_fields(record: Column) -> Column:
    def unmasked(v: Column) -> Column:
        for letter, meant in (("c", ","), ("n", "\n"), ("m", _MARK)):
            v = F.replace(v, F.lit(_MARK + letter), F.lit(meant))
        return v

    return F.transform(F.split(record, ","), unmasked)


def summarize_csv(df: DataFrame, text: str = "text_content", indexed: Column | None = None) -> DataFrame:
    """Add summary: columns, row count, first 5 rows of 5 columns (20 characters each), 30-line preview."""
    records = _csv_records(F.col(text))
    named = df.withColumn("__records", records).withColumn(
        "__header", _csv_fields(F.try_element_at("__records", F.lit(1)))
    )
    header = F.col("__header")

    def cell(v: Column, i: Column) -> Column:
        shown = F.when(v == "", "null").otherwise(head(v, 20))
        return F.concat(F.get(header, i), F.lit(":"), shown)

    def line(r: Column, i: Column) -> Column:
        first = F.slice(_csv_fields(r), 1, F.least(F.lit(5), F.size(header)))
        return F.concat(
            F.lit("  Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(first, cell), " | ")
        )

    rows = F.transform(F.slice("__records", 2, 5), line)
    parts = [
        F.concat(F.lit("CSV File: "), file_name("uri")),
        F.concat(F.lit("Location: "), F.col("uri")),
        F.lit("Type: CSV Spreadsheet\n"),
        F.concat(
            F.lit("Columns ("), F.size(header).cast("string"), F.lit("): "), F.array_join(header, ", "),
            F.lit("\nRows: "), (F.size("__records") - 1).cast("string"),
            F.lit("\n\nSample data (first 5 rows):"),
            F.when(F.size(rows) > 0, F.concat(F.lit("\n"), F.array_join(rows, "\n"))).otherwise(""),
        ),
        F.concat(F.lit("\nData preview:\n"), F.array_join(F.slice(F.split(F.col(text), "\n"), 1, 30), "\n")),
        *([] if indexed is None else [F.concat(F.lit("\nIndexed: "), indexed)]),
    ]
    return named.withColumn("summary", F.concat_ws("\n", *parts)).drop("__records", "__header")


def _extraction(text: Column, pages: Column, method: str) -> Column:
    trimmed = F.replace(head(text, 3000), F.lit("\n\n\n"), F.lit("\n\n"))
    return F.concat(
        F.lit("PDF File: "), file_name("uri"), F.lit("\nLocation: "), F.col("uri"),
        F.lit("\nPages: "), pages.cast("string"), F.lit(f"\nExtraction Method: {method}\n\nContent:\n"), trimmed,
        F.when(
            F.length(text) > 3000,
            F.concat(
                F.lit("\n... [Document contains "), F.length(text).cast("string"), F.lit(" characters total]")
            ),
        ).otherwise(""),
        F.lit(f"\n\nAnalysis: {method} extraction complete"),
    )


def choose_extraction(
    df: DataFrame, primary: str = "primary_text", fallback: str = "fallback_text", pages: str = "pages",
    primary_name: str = "Document AI (OCR)", fallback_name: str = "PyPDF2",
) -> DataFrame:
    """Add text_content and method: the first extractor unless it found nothing, then the second, then metadata."""

    def found(c: str) -> Column:
        text = F.col(c)
        return F.coalesce((F.length(text) > 0) & ~F.contains(text, F.lit(NO_TEXT)), F.lit(False))

    metadata = F.concat(
        F.lit("PDF Document: "), file_name("uri"), F.lit("\nLocation: "), F.col("uri"),
        F.lit("\n\nNote: Full text extraction failed; indexed with metadata only."),
    )
    pick = (
        F.when(found(primary), _extraction(F.col(primary), F.col(pages), primary_name))
        .when(found(fallback), _extraction(F.col(fallback), F.col(pages), fallback_name))
        .otherwise(metadata)
    )
    method = F.when(found(primary), "primary").when(found(fallback), "fallback").otherwise("metadata")
    return df.withColumns({"text_content": pick, "method": method})


def pending_extraction(documents: DataFrame, n: int | None = None, modality: str = "pdf") -> DataFrame:
    """Documents of a modality without extracted text; n gives a work list of that size."""
    todo = documents.where(
        (F.col("modality") == modality)
        & ~F.contains(F.lower("text_content"), F.lit(EXTRACTED.lower()))
    ).select("uri", "doc_id")
    return todo if n is None else todo.orderBy("doc_id").limit(n)


def apply_extraction(documents: DataFrame, extracted: DataFrame, limit: int = 50_000) -> DataFrame:
    """Replace the placeholder note with the extracted text of (doc_id, extracted_text), cut at limit."""
    kept = preview("extracted_text", limit, TRUNCATED)
    text = F.concat(
        F.regexp_replace("text_content", "Note: Full text extraction.*$", ""),
        F.lit(f"\n\n{EXTRACTED}\n"), kept,
    )
    joined = documents.join(extracted.select("doc_id", "extracted_text"), "doc_id", "left")
    done = F.coalesce(F.length("extracted_text") > 0, F.lit(False))
    return joined.withColumn("text_content", F.when(done, text).otherwise(F.col("text_content"))).select(
        documents.columns
    )


def distinct_uris(df: DataFrame) -> DataFrame:
    return df.select("uri").distinct()


_READERS = {
    "text": ingest_text,
    "markdown": ingest_markdown,
    "json": ingest_json,
    "csv": ingest_csv,
    "documents": ingest_office,
}


def build_documents(
    spark: SparkSession,
    root: str,
    modalities: Sequence[str] | None = None,
    no_video: bool = False,
    no_audio: bool = False,
    known: DataFrame | None = None,
    pdf_metadata: DataFrame | None = None,
    image_descriptions: DataFrame | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Documents of all requested modalities under root, as one DataFrame."""
    chosen = list(modalities) if modalities and "all" not in modalities else list(MODALITY_EXTENSIONS)
    unknown = set(chosen) - set(MODALITY_EXTENSIONS)
    if unknown:
        raise ValueError(f"unknown modalities: {sorted(unknown)}")
    chosen = [m for m in chosen if not (m == "video" and no_video) and not (m == "audio" and no_audio)]
    found = []
    for m in chosen:
        objects = scan_objects(spark, root, m, content=m in _READERS or (m == "pdf" and pdf_metadata is None))
        if m == "pdf":
            doc = (
                ingest_pdf_raw(objects, known, now)
                if pdf_metadata is None
                else ingest_pdf_annotated(objects, pdf_metadata, known, now)
            )
        elif m == "images" and image_descriptions is not None:
            doc = ingest_image_annotated(objects, image_descriptions, known, now)
        elif m in STUB_KINDS:
            doc = ingest_media_stub(objects, m, known, now)
        else:
            doc = _READERS[m](objects, known, now)
        found.append(doc)
    return reduce(DataFrame.unionByName, found)
