"""Declared schemas of the core, side and media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
_VEC = T.ArrayType(_D)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


# A third entry marks a required column.
DOCUMENT = _struct(
    ("doc_id", _S, "required"),
    ("uri", _S, "required"),
    ("modality", _S, "required"),
    ("source", _S, "required"),
    ("created_at", _TS, "required"),
    ("author", _S),
    ("channel", _S),
    ("text_content", _S),
    ("mime_type", _S),
    ("meta", _S),
    ("chunk_index", _L),
    ("chunk_start", _L),
    ("chunk_end", _L),
    ("embedding", _VEC),
)
PDF_METADATA = _struct(
    ("pdf_id", _S), ("uri", _S), ("title", _S), ("description", _S), ("category", _S),
    ("tags", T.ArrayType(_S)), ("created_at", _TS),
)
IMAGE_DESCRIPTIONS = _struct(
    ("image_id", _S), ("uri", _S), ("description", _S), ("tags", T.ArrayType(_S)), ("created_at", _TS)
)
SPEAKER_SEGMENT = _struct(
    ("speaker_id", _S), ("start_time", _D), ("end_time", _D), ("text", _S), ("confidence", _D)
)
SPOKEN_WORD = _struct(("word", _S), ("start_time", _D), ("end_time", _D), ("speaker_id", _S))
SCORED_WORD = _struct(("word", _S), ("start_time", _D), ("end_time", _D), ("confidence", _D))
LABEL = _struct(
    ("entity_id", _S), ("description", _S), ("language_code", _S),
    ("category_entities", T.ArrayType(_struct(("entity_id", _S), ("description", _S)))),
    ("segments", T.ArrayType(_struct(("start_time", _D), ("end_time", _D), ("confidence", _D)))),
)
BOX = _struct(("left_x", _D), ("top_y", _D), ("right_x", _D), ("bottom_y", _D))
AUDIO_METADATA = _struct(
    ("audio_id", _S, "required"), ("uri", _S, "required"), ("duration_seconds", _D), ("speaker_count", _L),
    ("transcription_confidence", _D), ("speaker_segments", T.ArrayType(SPEAKER_SEGMENT)),
    ("word_timestamps", T.ArrayType(SPOKEN_WORD)), ("processing_metadata", _S), ("created_at", _TS),
)
VIDEO_METADATA = _struct(
    ("video_id", _S, "required"), ("uri", _S, "required"), ("duration_seconds", _D), ("frame_rate", _D),
    ("width", _L), ("height", _L), ("codec", _S), ("segment_count", _L), ("shot_changes", _VEC),
    ("labels", T.ArrayType(LABEL)), ("processing_metadata", _S), ("created_at", _TS),
)
VIDEO_SEGMENTS = _struct(
    ("segment_id", _S, "required"), ("video_id", _S, "required"), ("uri", _S, "required"),
    ("segment_index", _L), ("start_time", _D), ("end_time", _D), ("duration", _D), ("shot_label", _S),
    ("confidence", _D), ("visual_embedding", _VEC), ("embedding_model", _S), ("key_frame_uri", _S),
    ("metadata", _S), ("created_at", _TS),
)
VIDEO_TRANSCRIPTS = _struct(
    ("transcript_id", _S, "required"), ("video_id", _S, "required"), ("uri", _S, "required"),
    ("segment_id", _S), ("start_time", _D), ("end_time", _D), ("speaker_id", _S), ("text", _S),
    ("confidence", _D), ("word_timestamps", T.ArrayType(SCORED_WORD)), ("text_embedding", _VEC),
    ("language_code", _S), ("created_at", _TS),
)
VIDEO_OCR_TEXT = _struct(
    ("ocr_id", _S, "required"), ("video_id", _S, "required"), ("uri", _S, "required"), ("segment_id", _S),
    ("frame_time", _D), ("text", _S), ("confidence", _D), ("bounding_box", BOX), ("text_embedding", _VEC),
    ("created_at", _TS),
)

# Table name -> (schema, columns a file is sorted by).
CORE_TABLES = {
    "documents": (DOCUMENT, ["modality", "source"]),
    "document_chunks": (DOCUMENT, ["modality", "source"]),
    "search_corpus": (DOCUMENT, ["modality", "source"]),
}
SIDE_TABLES = {
    "pdf_metadata": (PDF_METADATA, ["uri"]),
    "image_descriptions": (IMAGE_DESCRIPTIONS, ["uri"]),
    "audio_metadata": (AUDIO_METADATA, ["uri"]),
    "video_metadata": (VIDEO_METADATA, ["uri"]),
    "video_segments": (VIDEO_SEGMENTS, ["video_id", "segment_index"]),
    "video_transcripts": (VIDEO_TRANSCRIPTS, ["video_id"]),
    "video_ocr_text": (VIDEO_OCR_TEXT, ["video_id"]),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in order; a column the input lacks becomes NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
