"""Transcripts, speakers, shots, on-screen text and media search.

One recording may hold a large share of all rows, so ordered work inside a recording is cut into stretches
of time that are handled on their own and stitched by small per-stretch summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from semcorpus.functions.groups import map_groups
from semcorpus.functions.text import file_name, head, preview
from semcorpus.functions.text import words as words_of
from semcorpus.functions.vectors import hash_embed
from semcorpus.operators.knn import knn
from semcorpus.operators.search import query_vector
from semcorpus.settings import DEFAULTS, Settings

# Prices per minute, sampled shares, segment bounds in seconds, default confidence.
PRICES = {"shot_detection": 0.10, "speech_transcription": 0.048, "text_detection": 0.15, "label_detection": 0.10}
SAMPLED_SHARE = {"minimal": 0.3, "efficient": 0.5, "full": 1.0}
SAMPLE_INTERVAL = {"minimal": 30.0, "efficient": 10.0, "full": 0.0}
MIN_SEGMENT, MAX_SEGMENT = 1.0, 30.0
CONFIDENCE = 0.95
# Label categories in order of precedence, with the word parts that select them.
CATEGORIES = [
    ("People", ["person", "people", "face", "human"]),
    ("Animals", ["animal", "dog", "cat", "bird"]),
    ("Transportation", ["car", "vehicle", "transport"]),
    ("Nature", ["nature", "outdoor", "landscape"]),
    ("Sports", ["sport", "game", "activity"]),
]


def running_before(df: DataFrame, key: str, part: Column, order: Sequence, value: Column, name: str) -> DataFrame:
    """Add the sum of value over the rows of a key that come before this one.

    part must rise with the order. Sums run inside each part, and the totals of earlier parts are added on.
    """
    placed = df.withColumn("__part", part).withColumn("__value", value)
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(*earlier)
    along = Window.partitionBy(key).orderBy("__part").rowsBetween(*earlier)
    offsets = (
        placed.groupBy(key, "__part").agg(F.sum("__value").alias("__total"))
        .select(key, "__part", F.coalesce(F.sum("__total").over(along), F.lit(0)).alias("__offset"))
    )
    return (
        placed.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .join(offsets, [key, "__part"])
        .select(*df.columns, (F.col("__offset") + F.col("__inside")).alias(name))
    )


# --- speakers ----------------------------------------------------------------------------------------


# Width of a stretch in word numbers. A recognised result has numbers of its own (see speech_result_table).
STRETCH = 1 << 16


# Word numbers that a mark of a speaker covers, a bit for each.
MARKED = 64


def _turn(order: WindowSpec, present: str, last: str, now: str) -> Column:
    """1 where there is a row before and it has another speaker, else 0."""
    return (F.lag(present).over(order).isNotNull() & ~F.lag(last).over(order).eqNullSafe(F.col(now))).cast("long")


def _stretches(placed: DataFrame, key: str) -> DataFrame:
    """(key, __part, __turns, __first, __last): how often the speaker changes inside a stretch, and who speaks first and last.

    Tasks combine the words of a speaker into marks before anything is shuffled. A mark that no other speaker shares is
    one row for all its words; else each of its word numbers is one. Words without a number are a stretch before all
    others, in which the speaker of the first of them speaks on.
    """
    seq = F.col("seq").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(seq, F.lit(MARKED)).cast("int"))
    row = F.when(F.col("seq").isNull(), F.monotonically_increasing_id())
    said = placed.select(key, "__part", F.shiftright(seq, 6).alias("__mark"), "speaker_id", bit.alias("__bit"), row.alias("__row"))
    marks = said.groupBy(key, "__part", "__mark", "speaker_id").agg(F.bit_or("__bit").alias("__bits"), F.min("__row").alias("__row"))
    sharing = F.count(F.lit(1)).over(Window.partitionBy(key, "__part", "__mark"))
    each = F.filter(F.sequence(F.lit(0), F.lit(MARKED - 1)), lambda n: F.getbit("__bits", n) == 1)
    shared = marks.repartition(key, "__part").withColumn("__sharing", sharing)
    one = (F.col("__sharing") == 1) | F.col("__bits").isNull()
    rows = shared.withColumn("__at", F.explode(F.when(one, F.array(F.lit(0))).otherwise(each)))
    order = ["__mark", "__at", "__row", "speaker_id"]
    turn = _turn(Window.partitionBy(key, "__part").orderBy(*order), "__mark", "speaker_id", "speaker_id")
    first, last = F.min_by("speaker_id", F.struct(*order)), F.max_by("speaker_id", F.struct(*order))
    return rows.withColumn("__turn", turn).groupBy(key, "__part").agg(
        F.sum("__turn").alias("__turns"), first.alias("__first"),
        F.when(F.col("__part").isNull(), first).otherwise(last).alias("__last"),
    )


def _offsets(placed: DataFrame, key: str) -> DataFrame:
    """(key, __part, __base): how many runs of the recording were opened before the first of a stretch, that one included if
    it goes on with the last speaker of the stretch before. Only one row per stretch is put in order.
    """
    along = Window.partitionBy(key).orderBy("__part")
    opens = _turn(along, "__turns", "__last", "__first")
    marked = _stretches(placed, key).select(key, "__part", "__turns", opens.alias("__opens"))
    before = F.coalesce(F.sum("__turns").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.select(key, "__part", (before + F.sum("__opens").over(along)).alias("__base"))


def _numbered(words: DataFrame, stretch: int, key: str) -> DataFrame:
    """Words with __part, the stretch they stand in, and run_no, the run of one speaker within the recording, from 0.

    Words without a recording or a number are left out; the latter count as words before the first.
    """
    placed = words.where(F.col(key).isNotNull()).withColumn("__part", F.floor(F.col("seq") / stretch).cast("long"))
    # The base of a stretch is a row before its first word, with which the count of runs begins: no join is needed.
    bases = _offsets(placed, key).where(F.col("__part").isNotNull())
    both = placed.where(F.col("seq").isNotNull()).unionByName(bases, allowMissingColumns=True)
    inside = Window.partitionBy(key, "__part")
    opened = F.coalesce("__base", _turn(inside.orderBy("seq", "speaker_id"), "seq", "speaker_id", "speaker_id"))
    counted = both.withColumn("__opened", opened).withColumn("run_no", F.sum("__opened").over(inside.orderBy("seq")))
    return counted.where(F.col("seq").isNotNull()).drop("__opened", "__base")


def speaker_runs(words: DataFrame, stretch: int = STRETCH, key: str = "media_id") -> DataFrame:
    """Number the runs of one speaker within each recording: adds run_no, counted from 0.

    Words are (media_id, seq, word, start_time, end_time, speaker_id, ...), in the order of seq, whatever their times;
    a missing speaker is a speaker of its own, and speakers of one word number take turns in their order. Runs are found
    inside stretches of a recording and joined where one goes on in the next stretch.
    """
    return _numbered(words, stretch, key).drop("__part")


def speaker_segments(
    words: DataFrame, confidence: str | None = None, stretch: int = STRETCH, key: str = "media_id"
) -> DataFrame:
    """Consecutive words of one speaker as one segment, from its first word's start to its last word's end.

    confidence names the column whose first value is kept. Words are joined per run and stretch, where they
    already lie together; only the pieces are shuffled.
    """
    value = F.lit(CONFIDENCE) if confidence is None else F.min_by(confidence, "seq")
    spoken = F.array_sort(F.collect_list(F.struct("seq", "word")))
    # What differs from word to word lies together, the text last: such rows are smaller when they are shuffled.
    named = [key, "speaker_id", "seq", "start_time", "end_time", *([] if confidence is None else [confidence]), "word"]
    pieces = _numbered(words.select(*dict.fromkeys(named)), stretch, key).groupBy(key, "__part", "run_no").agg(
        F.first("speaker_id").alias("speaker_id"),
        F.min_by("start_time", "seq").alias("start_time"),
        F.max_by("end_time", "seq").alias("end_time"),
        F.array_join(F.transform(spoken, lambda w: w["word"]), " ").alias("text"),
        value.alias("confidence"),
        F.count(F.lit(1)).alias("word_count"),
    )
    texts = F.array_sort(F.collect_list(F.struct("__part", "text")))
    return pieces.groupBy(key, F.col("run_no").alias("segment_index")).agg(
        F.first("speaker_id").alias("speaker_id"),
        F.min_by("start_time", "__part").alias("start_time"),
        F.max_by("end_time", "__part").alias("end_time"),
        F.array_join(F.transform(texts, lambda p: p["text"]), " ").alias("text"),
        F.min_by("confidence", "__part").alias("confidence"),
        F.sum("word_count").alias("word_count"),
    )


def speech_result_table(results: DataFrame) -> DataFrame:
    """Flatten recognised alternatives with nested words into the words table.

    Input: media_id, result_no, words ARRAY<STRUCT<word, start_time, end_time, speaker_id, confidence>>.
    Missing times count as 0 and a missing speaker as '0'.
    """
    flat = results.select("media_id", "result_no", F.posexplode("words").alias("word_no", "w"))
    return flat.select(
        "media_id",
        (F.col("result_no") * F.lit(1 << 32) + F.col("word_no")).alias("seq"),
        F.col("w.word").alias("word"),
        F.coalesce(F.col("w.start_time"), F.lit(0.0)).alias("start_time"),
        F.coalesce(F.col("w.end_time"), F.lit(0.0)).alias("end_time"),
        F.coalesce(F.col("w.speaker_id").cast("string"), F.lit("0")).alias("speaker_id"),
        F.coalesce(F.col("w.confidence"), F.lit(CONFIDENCE)).alias("confidence"),
    )


def transcript_rows(segments: DataFrame, key: str = "media_id") -> DataFrame:
    """Speaker segments as transcript rows with ids."""
    return segments.select(
        F.concat(F.col(key), F.lit("_transcript_"), F.col("segment_index").cast("string")).alias("transcript_id"),
        F.col(key).alias("video_id"), "start_time", "end_time", "speaker_id", "text", "confidence",
    )


def transcript_facts(words: DataFrame, results: DataFrame | None = None, key: str = "media_id") -> DataFrame:
    """Duration, speakers and words per recording; with results also the mean of their non-zero confidence."""
    facts = words.groupBy(key).agg(
        F.max("end_time").alias("duration_seconds"),
        F.greatest(F.countDistinct("speaker_id"), F.lit(1)).alias("speaker_count"),
        F.count(F.lit(1)).alias("word_count"),
    )
    if results is None:
        return facts
    sure = results.groupBy(key).agg(
        F.coalesce(F.avg(F.nullif(F.col("confidence"), F.lit(0.0))), F.lit(0.0)).alias("confidence")
    )
    return facts.join(sure, key, "full_outer").select(
        key, F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("speaker_count", F.lit(1)).alias("speaker_count"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def speaker_chunks(segments: DataFrame, key: str = "media_id") -> DataFrame:
    """One chunk per speaker segment, labelled with the speaker."""
    return segments.select(
        key, F.col("segment_index").alias("chunk_index"),
        F.concat(F.lit("[Speaker "), F.col("speaker_id"), F.lit("] "), F.col("text")).alias("text"),
        "start_time", "end_time", "speaker_id", (F.col("end_time") - F.col("start_time")).alias("duration"),
    )


# Recognised results in one part of a running sum.
RESULTS_PER_PART = 1000


def word_windows(
    results: DataFrame, size: int = 500, overlap: int = 100, key: str = "media_id", text: str = "transcript"
) -> DataFrame:
    """Windows of size words over the results of a recording in order, one every size - overlap words.

    Words are numbered through the recording and grouped by the windows they fall in, so a long recording
    is never gathered into one row. Input: media_id, result_no, transcript.
    """
    stride = size - overlap
    split = results.select(key, "result_no", words_of(text).alias("__w"))
    based = running_before(
        split, key, F.floor(F.col("result_no") / RESULTS_PER_PART), ["result_no"], F.size("__w"), "__base"
    )
    flat = based.select(key, "__base", F.posexplode("__w").alias("__pos", "word")).withColumn(
        "__n", F.col("__base") + F.col("__pos")
    )
    last = F.floor(F.col("__n") / stride)
    first = F.greatest(F.floor((F.col("__n") - size) / stride) + 1, F.lit(0))
    placed = flat.withColumn("chunk_index", F.explode(F.sequence(first, last)))
    ordered = F.array_sort(F.collect_list(F.struct("__n", "word")))
    return placed.groupBy(key, "chunk_index").agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text")
    )


def audio_chunks(segments: DataFrame, results: DataFrame, facts: DataFrame, key: str = "media_id") -> DataFrame:
    """Speaker chunks, or word windows for recordings without speaker segments."""
    bare = results.join(segments.select(key).distinct(), key, "left_anti")
    lengths = facts.select(key, "duration_seconds")
    windows = word_windows(bare, key=key).join(lengths, key, "left").select(
        key, "chunk_index", "text", F.lit(0.0).alias("start_time"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("end_time"), F.lit(None).cast("string").alias("speaker_id"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration"),
    )
    return speaker_chunks(segments, key).unionByName(windows)


def transcript_start(results: DataFrame, n: int = 2000, key: str = "media_id", text: str = "transcript") -> DataFrame:
    """The results of a recording joined in order, as far as a preview of n characters needs them."""
    before = running_before(
        results.select(key, "result_no", text), key, F.floor(F.col("result_no") / RESULTS_PER_PART), ["result_no"],
        F.length(text) + 1, "__before",
    )
    parts = F.array_sort(F.collect_list(F.struct("result_no", F.col(text).alias("t"))))
    return before.where(F.col("__before") <= n + 1).groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text)
    )


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _indexed(indexed: Column | None) -> list:
    return [] if indexed is None else ["", F.concat(F.lit("Indexed: "), indexed)]


def audio_document(audio: DataFrame, indexed: Column | None = None) -> DataFrame:
    """Add text_content for (uri, transcript, duration_seconds, speaker_count, confidence)."""
    text = _lines(
        F.concat(F.lit("Audio File: "), file_name("uri")),
        F.format_string("Duration: %.1f seconds", F.col("duration_seconds")),
        F.concat(F.lit("Speakers: "), F.col("speaker_count").cast("string")),
        F.format_string("Confidence: %.1f%%", F.col("confidence") * 100),
        "",
        "Transcription:",
        preview("transcript", 2000),
        *_indexed(indexed),
    )
    return audio.withColumn("text_content", text)


# --- shots and segments ------------------------------------------------------------------------------


def _next_kept(starts: np.ndarray, interval: float) -> np.ndarray:
    """For each sorted start, the position of the next one kept after it."""
    return np.searchsorted(starts, starts + interval, side="left")


def sample_shots(
    shots: DataFrame, interval: float, key: str = "video_id", stretch: int = 1000, number: str | None = None
) -> DataFrame:
    """Keep a shot when it starts at least interval after the last kept one; number names a running count.

    Each video is cut into stretches of time. Where the sampling enters a stretch depends on what came
    before, but it can only be at one of the shots in the stretch's first interval or the next one after.
    A first pass maps each such entry to where the sampling leaves the stretch and how many shots it keeps,
    a second follows one entry per stretch through a video, a third marks the kept shots of each stretch.
    Among equal starts the lowest shot_index is kept.
    """
    if interval <= 0:
        return shots
    span = interval * stretch
    counted = number or "__number"
    placed = shots.withColumn("__part", F.floor(F.col("start_time") / span).cast("long"))

    def one(table: pa.Table, column: str):
        return table.column(column)[0].as_py()

    def exits(table: pa.Table) -> pa.Table:
        starts = np.unique(table.column("start_time").to_numpy())
        after = _next_kept(starts, interval)
        leave, kept = starts + interval, np.ones(len(starts), dtype=np.int64)
        for i in range(len(starts) - 1, -1, -1):
            if after[i] < len(starts):
                leave[i] = leave[after[i]]
                kept[i] = kept[after[i]] + 1
        entry = int(np.searchsorted(starts, one(table, "__part") * span + interval, side="left")) + 1
        starts, leave, kept = starts[:entry], leave[:entry], kept[:entry]
        # Of entries that leave alike only the last is needed.
        last = np.append((leave[1:] != leave[:-1]) | (kept[1:] != kept[:-1]), True)
        return pa.table({
            key: pa.array([one(table, key)], pa.string()),
            "__part": pa.array([one(table, "__part")], pa.int64()),
            "entries": pa.array([starts[last].tolist()], pa.list_(pa.float64())),
            "leave": pa.array([leave[last].tolist()], pa.list_(pa.float64())),
            "kept": pa.array([kept[last].tolist()], pa.list_(pa.int64())),
        })

    def follow(table: pa.Table) -> pa.Table:
        due, before, dues, befores = -np.inf, 0, [], []
        for entries, leave, kept in zip(*(table.column(c).to_pylist() for c in ("entries", "leave", "kept"))):
            dues.append(due)
            befores.append(before)
            i = int(np.searchsorted(entries, due, side="left"))
            if i < len(entries):
                due, before = leave[i], before + kept[i]
        return pa.table({
            key: table.column(key), "__part": table.column("__part"),
            "__due": pa.array(dues, pa.float64()), "__before": pa.array(befores, pa.int64()),
        })

    fields = shots.schema.fields

    def keep(table: pa.Table) -> pa.Table:
        starts = table.column("start_time").to_numpy()
        at, kept = int(np.searchsorted(starts, one(table, "__due"), side="left")), []
        after = _next_kept(starts, interval)
        while at < len(starts):
            kept.append(at)
            at = int(after[at])
        rows = table.take(pa.array(kept, pa.int64())).select([f.name for f in fields])
        return rows.append_column(counted, pa.array(np.arange(len(kept)) + one(table, "__before"), pa.int64()))

    left = map_groups(
        placed.select(key, "__part", "start_time"), [key, "__part"], ["start_time"], exits,
        f"{key} string, __part long, entries array<double>, leave array<double>, kept array<long>",
    )
    due = map_groups(left, [key], ["__part"], follow, f"{key} string, __part long, __due double, __before long")
    schema = T.StructType([*fields, T.StructField(counted, T.LongType())])
    again = placed.select(*[F.col(c).alias(c) for c in placed.columns]).join(due, [key, "__part"])
    kept = map_groups(again, [key, "__part"], ["start_time", "shot_index"], keep, schema)
    return kept if number else kept.drop(counted)


def shot_order(shots: DataFrame, key: str = "video_id", stretch: float = 3600.0) -> DataFrame:
    """Renumber shots 0, 1, ... per video by start."""
    return running_before(
        shots, key, F.floor(F.col("start_time") / stretch).cast("long"), ["start_time", "shot_index"], F.lit(1), "__no"
    ).withColumn("shot_index", F.col("__no")).drop("__no")


def shots_to_segments(shots: DataFrame, mode: str = "efficient", key: str = "video_id") -> DataFrame:
    """Segments of (video_id, shot_index, start_time, end_time).

    Sampled modes thin the shots, renumber them and clamp segments to 30 s; full mode splits longer shots
    into int(d / 30) + 1 equal parts. Shots under one second are dropped, and ids keep the shot's number.
    """
    interval = SAMPLE_INTERVAL.get(mode, SAMPLE_INTERVAL["efficient"])
    numbered = shots
    if interval > 0:
        numbered = sample_shots(shots, interval, key, number="__kept").withColumn("shot_index", F.col("__kept")).drop("__kept")
    span = F.col("end_time") - F.col("start_time")
    base = numbered.withColumn("__span", span).where(F.col("__span") >= MIN_SEGMENT)
    number = F.col("shot_index").cast("string")
    name = F.concat(F.col(key), F.lit("_shot_"), number)
    label = F.concat(F.lit("shot_"), number)
    conf = F.lit(CONFIDENCE).alias("confidence")
    if interval > 0:
        return base.select(
            name.alias("segment_id"), key, "shot_index", "start_time",
            F.least(F.col("end_time"), F.col("start_time") + MAX_SEGMENT).alias("end_time"),
            F.least(F.col("__span"), F.lit(MAX_SEGMENT)).alias("duration"), label.alias("shot_label"), conf,
        )
    split = F.col("__span") > MAX_SEGMENT
    parts = F.when(split, F.floor(F.col("__span") / MAX_SEGMENT) + 1).otherwise(1)
    cut = base.withColumn("__parts", parts).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__parts").cast("int") - 1)))
    step = F.col("__span") / F.col("__parts")
    part = F.col("__j").cast("string")
    return cut.select(
        F.when(split, F.concat(name, F.lit("_"), part)).otherwise(name).alias("segment_id"),
        key, "shot_index",
        (F.col("start_time") + F.col("__j") * step).alias("start_time"),
        F.when(split, F.col("start_time") + (F.col("__j") + 1) * step).otherwise(F.col("end_time")).alias("end_time"),
        F.when(split, step).otherwise(F.col("__span")).alias("duration"),
        F.when(split, F.concat(label, F.lit("_part_"), part)).otherwise(label).alias("shot_label"),
        conf,
    )


def video_facts(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments and length per video."""
    return segments.groupBy(key).agg(
        F.count(F.lit(1)).alias("segment_count"), F.max("end_time").alias("duration_seconds")
    )


def shot_changes(segments: DataFrame, key: str = "video_id", stretch: float = 86_400.0) -> DataFrame:
    """Ordered segment starts per video, one array per stretch of a day, so that no array is unbounded."""
    return segments.groupBy(key, F.floor(F.col("start_time") / stretch).cast("long").alias("day")).agg(
        F.array_sort(F.collect_list("start_time")).alias("shot_changes")
    )


def segment_text(transcript: str = "transcript_text", ocr: str = "ocr_text") -> Column:
    """Text of a segment: its bounds, then transcript and on-screen text where there are any."""

    def extra(lead: str, c: str) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(lead), F.col(c))).otherwise("")

    return F.concat(
        F.format_string("Video segment from %.1fs to %.1fs", "start_time", "end_time"),
        extra(" Transcript: ", transcript), extra(" On-screen text: ", ocr),
    )


def segment_embeddings(segments: DataFrame, dim: int = DEFAULTS.dim, embed=None) -> DataFrame:
    text = segment_text()
    return segments.withColumn("visual_embedding", hash_embed(text, dim) if embed is None else embed(text))


def processing_cost(videos: DataFrame, mode: str = "efficient", minutes: str = "minutes") -> DataFrame:
    """Cost per feature and in total; an unknown mode is charged in full for shots and speech."""
    m, share = F.col(minutes), F.lit(SAMPLED_SHARE.get(mode, 1.0))
    full = mode == "full"
    costs = {
        "shot_detection": F.lit(PRICES["shot_detection"]) * m * share,
        "speech_transcription": F.lit(PRICES["speech_transcription"]) * m * share,
        "text_detection": F.lit(PRICES["text_detection"]) * m if full else F.lit(0.0),
        "label_detection": F.lit(PRICES["label_detection"]) * m if full else F.lit(0.0),
    }
    priced = videos.withColumns(costs)
    return priced.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in costs]))


def ocr_result_table(hits: DataFrame, key: str = "video_id") -> DataFrame:
    """On-screen text hits with mid time and the box around the vertices of the first frame.

    Input: video_id, hit_no, text, start_time, end_time, confidence, vertices ARRAY<STRUCT<x, y>>.
    """
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    box = F.when(
        F.size("vertices") > 0,
        F.struct(
            F.array_min(xs).alias("left_x"), F.array_min(ys).alias("top_y"),
            F.array_max(xs).alias("right_x"), F.array_max(ys).alias("bottom_y"),
        ),
    )
    return hits.select(
        F.concat(F.col(key), F.lit("_ocr_"), F.col("hit_no").cast("string")).alias("ocr_id"),
        F.col(key).alias("video_id"),
        ((F.col("start_time") + F.col("end_time")) / 2).alias("frame_time"),
        "text", "confidence", box.alias("bounding_box"),
    )


# --- documents of videos -----------------------------------------------------------------------------


def _first(df: DataFrame, key: str, order: list[str], n: int, value: Column, name: str) -> DataFrame:
    """The first n values per video, ordered; later rows never enter the array."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return kept.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__n", value.alias("v")))), lambda s: s["v"]).alias(name)
    )


def video_document(
    videos: DataFrame, segments: DataFrame, transcripts: DataFrame, ocr: DataFrame,
    indexed: Column | None = None, key: str = "video_id",
) -> DataFrame:
    """Add text_content: name, segment count, first 3 transcripts, distinct texts among the first 5 hits."""
    line = F.concat(
        F.lit("  ["), F.coalesce("speaker_id", F.lit("Speaker")), F.lit("]: "), head("text", 100), F.lit("...")
    )
    spoken = _first(transcripts, key, ["start_time", "transcript_id"], 3, line, "__said")
    shown = _first(ocr, key, ["frame_time", "ocr_id"], 5, F.col("text"), "__shown")
    counts = segments.groupBy(key).agg(F.count(F.lit(1)).alias("segment_count"))
    joined = videos.join(counts, key, "left").join(spoken, key, "left").join(shown, key, "left")
    said = F.when(
        F.col("__said").isNotNull(), F.concat(F.lit("Transcript excerpts:\n"), F.array_join("__said", "\n"), F.lit("\n"))
    )
    texts = F.transform(F.array_distinct("__shown"), lambda t: F.concat(F.lit("  - "), head(t, 50)))
    seen = F.when(
        F.col("__shown").isNotNull(),
        F.concat(F.lit("On-screen text detected:\n"), F.array_join(texts, "\n"), F.lit("\n")),
    )
    text = _lines(
        F.concat(F.lit("Video File: "), file_name("uri")),
        F.concat(F.lit("Segments: "), F.coalesce("segment_count", F.lit(0)).cast("string"), F.lit("\n")),
        said, seen, *([] if indexed is None else [F.concat(F.lit("Indexed: "), indexed)]),
    )
    return joined.withColumn("text_content", text).drop("__said", "__shown")


def label_category(label: Column | str) -> Column:
    """Category of a label by the first rule one of whose word parts it contains; NULL when none does."""
    low = F.lower(F.col(label) if isinstance(label, str) else label)
    out = F
    for name, parts in CATEGORIES:
        out = out.when(F.rlike(low, F.lit("|".join(parts))), name)
    return out.otherwise(F.lit(None).cast("string"))


def label_categories(labels: DataFrame, key: str = "video_id", label: str = "label") -> DataFrame:
    """The set of categories per video. Distinct pairs are made map-side before grouping."""
    pairs = labels.select(key, label_category(label).alias("category")).where(F.col("category").isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list("category")).alias("categories"))


def _percent(name: Column, conf: Column) -> Column:
    return F.format_string("%s (%.1f%%)", name, conf * 100)


def video_label_document(annotations: DataFrame, indexed: Column | None = None) -> DataFrame:
    """Add text_content for a row per video with nested annotations.

    Input: uri, duration_seconds, labels and objects ARRAY<STRUCT<description, confidence>>, shot_labels and
    texts ARRAY<STRING>, speech ARRAY<STRUCT<transcript, confidence>>, shot_count.
    """

    def section(title: str, has: Column, body: Column) -> Column:
        return F.when(has, F.concat(F.lit(f"\n{title}:\n"), body))

    def percents(c: str) -> Column:
        return F.array_join(F.transform(F.slice(c, 1, 10), lambda s: _percent(s["description"], s["confidence"])), ", ")

    speech = F.array_join(
        F.transform(F.filter("speech", lambda s: s["confidence"] > 0.5), lambda s: s["transcript"]), " "
    )
    categories = F.array_sort(F.array_distinct(F.array_compact(
        F.transform(F.slice("labels", 1, 30), lambda s: label_category(s["description"]))
    )))
    text = _lines(
        F.concat(F.lit("Video File: "), file_name("uri")),
        F.concat(F.lit("Location: "), F.col("uri")),
        "Type: Video Content\n",
        F.concat(F.lit("Duration: "), F.col("duration_seconds").cast("long").cast("string"), F.lit(" seconds")),
        section("Video Content Labels", F.size("labels") > 0, percents("labels")),
        section("Scene Elements", F.size("shot_labels") > 0, F.array_join(F.slice("shot_labels", 1, 10), ", ")),
        section("Tracked Objects", F.size("objects") > 0, percents("objects")),
        section("Text in Video", F.size("texts") > 0, F.array_join(F.slice("texts", 1, 5), ", ")),
        section("Speech Transcription", F.length(speech) > 0, preview(speech, 500)),
        F.when(F.col("shot_count") > 0, F.concat(F.lit("\nScene Changes: "), F.col("shot_count").cast("string"), F.lit(" detected"))),
        F.when(F.size(categories) > 0, F.concat(F.lit("\nCategories: "), F.array_join(categories, ", "))),
        "\nAnalysis: Video Intelligence API analysis complete",
        *_indexed(indexed)[1:],
    )
    return annotations.withColumn("text_content", text)


def video_label_summary(annotations: DataFrame, indexed: Column | None = None) -> DataFrame:
    """The short form: up to 15 labels and the scene count."""
    names = F.transform(F.slice("labels", 1, 15), lambda s: s["description"])
    text = _lines(
        F.concat(F.lit("Video File: "), file_name("uri")),
        F.concat(F.lit("Location: "), F.col("uri")),
        "Type: Video Content\n",
        F.when(F.size("labels") > 0, F.concat(F.lit("Content: "), F.array_join(names, ", "))),
        F.when(F.col("shot_count") > 0, F.concat(F.lit("Scenes: "), F.col("shot_count").cast("string"))),
        "\nAnalysis: Video Intelligence (basic) complete",
        *_indexed(indexed)[1:],
    )
    return annotations.withColumn("text_content", text)


# --- search ------------------------------------------------------------------------------------------


def new_files(listed: DataFrame, processed: DataFrame, key: str = "uri") -> DataFrame:
    seen = processed.select(key).where(F.col(key).isNotNull())
    return listed.join(seen, key, "left_anti")


def keep_first(results: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The best row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return results.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def _media_knn(df: DataFrame, vec: str, q, k: int, kind: str, end: Column, hit_id: str, extra: list[str]) -> DataFrame:
    start = "frame_time" if kind == "ocr" else "start_time"
    near = knn(df, q, k, hit_id, vec)
    return near.select(
        "video_id", "uri", F.col(start).alias("start_time"), end.alias("end_time"), *extra,
        (1 - F.col("distance")).alias("score"), F.lit(kind).alias("result_type"), F.col(hit_id).alias("hit_id"),
    )


def search_media(
    query, transcripts: DataFrame, ocr: DataFrame, segments: DataFrame, search_type: str = "hybrid",
    k: int = 10, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Best k hits in transcripts, on-screen text and segments; one hit per (video, start time)."""
    q = query_vector(query, settings.dim)
    found = []
    if search_type in ("transcript", "hybrid"):
        found.append(_media_knn(transcripts, "text_embedding", q, k, "transcript", F.col("end_time"), "transcript_id", ["text", "speaker_id"]))
    if search_type in ("ocr", "hybrid"):
        found.append(_media_knn(ocr, "text_embedding", q, k, "ocr", F.col("frame_time") + 1, "ocr_id", ["text"]))
    if search_type in ("visual", "hybrid"):
        found.append(_media_knn(segments, "visual_embedding", q, k, "visual", F.col("end_time"), "segment_id", ["shot_label"]))
    if not found:
        raise ValueError(f"unknown search type {search_type!r}")
    hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    best = [F.col("score").desc(), F.col("result_type"), F.col("hit_id")]
    return keep_first(hits, ["video_id", "start_time"], best).orderBy(*best).limit(k)
