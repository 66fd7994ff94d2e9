"""Media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcorpus.functions.text import tidy
from semcorpus.operators import media as m
from semcorpus.plans import inputs as i
from semcorpus.plans.inputs import SHOTS, TOPICS, WORDS
from semcorpus.plans.registry import query

# Runs of one speaker over the turns; words of a run are its turns joined by blanks.
RUNS = f"""{WORDS}, marked AS (SELECT *, CASE WHEN lag(speaker_id) OVER (PARTITION BY media_id ORDER BY turn, word_no)
    <> speaker_id THEN 1 ELSE 0 END AS flip FROM words), runs AS (SELECT *, sum(flip) OVER (PARTITION BY media_id
    ORDER BY turn, word_no) AS run FROM marked), segs AS (SELECT media_id, CAST(run AS BIGINT) AS segment_index,
    any_value(speaker_id) AS speaker_id, min(start_time) AS start_time, max(start_time) + 0.5 AS end_time,
    string_agg(word, ' ' ORDER BY turn, word_no) AS text, first(confidence ORDER BY turn, word_no) AS confidence,
    count(*) AS word_count FROM runs GROUP BY media_id, run)"""


@query("speech_words", f"""WITH {WORDS} SELECT media_id, CAST(turn * 4294967296 + word_no AS BIGINT) AS seq, word, start_time,
    start_time + 0.5 AS end_time, speaker_id, round(confidence, 6) AS confidence FROM words""")
def speech_words(spark, sf):
    return i.spoken(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query("speaker_segments", f"""WITH {RUNS} SELECT media_id, segment_index, speaker_id, start_time, end_time, text,
    round(confidence, 6) AS confidence, word_count FROM segs""")
def speaker_segments(spark, sf):
    segments = m.speaker_segments(i.spoken(spark, sf), "confidence", stretch=64)
    return segments.withColumn("confidence", F.round("confidence", 6))


# Recognised results with missing times, NULL speakers and overlapping channels: order is that of results and words.
_ROUGH = """turns AS (SELECT conv_id, turn, role, string_split(text, ' ') AS parts FROM conversations),
    words AS (SELECT 'c' || conv_id AS media_id, turn, unnest(parts) AS word, generate_subscripts(parts, 1) - 1 AS word_no,
        CASE WHEN (turn + generate_subscripts(parts, 1)) % 4 = 0 THEN 0 ELSE generate_subscripts(parts, 1) - turn % 3 END::DOUBLE
            AS start_time,
        CASE WHEN turn % 5 = 0 AND generate_subscripts(parts, 1) % 7 < 3 THEN NULL ELSE role END AS speaker_id FROM turns),
    marked AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker_id) OVER w IS DISTINCT FROM speaker_id
        THEN 1 ELSE 0 END AS flip FROM words WINDOW w AS (PARTITION BY media_id ORDER BY turn, word_no)),
    runs AS (SELECT *, sum(flip) OVER (PARTITION BY media_id ORDER BY turn, word_no) AS run FROM marked)"""


@query("speaker_segments_rough", f"""WITH {_ROUGH} SELECT media_id, CAST(run AS BIGINT) AS segment_index,
    any_value(speaker_id) AS speaker_id, first(start_time ORDER BY turn, word_no) AS start_time,
    last(start_time ORDER BY turn, word_no) AS end_time, string_agg(word, ' ' ORDER BY turn, word_no) AS text,
    count(*) AS word_count FROM runs GROUP BY media_id, run""")
def speaker_segments_rough(spark, sf):
    c = i.table(spark, sf, "conversations")
    n = F.col("word_no") + 1
    words = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", " ")).alias("word_no", "word")).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("media_id"),
        (F.col("turn") * F.lit(1 << 32) + F.col("word_no")).alias("seq"), "word",
        F.when((F.col("turn") + n) % 4 != 0, n - F.col("turn") % 3).otherwise(0).cast("double").alias("start_time"),
        F.when(~((F.col("turn") % 5 == 0) & (n % 7 < 3)), F.col("role")).alias("speaker_id"),
    ).withColumn("end_time", F.col("start_time"))
    return m.speaker_segments(words, stretch=16).drop("confidence")


@query("transcript_rows", f"""WITH {RUNS} SELECT media_id || '_transcript_' || segment_index AS transcript_id,
    media_id AS video_id, start_time, end_time, speaker_id, text, 0.95::DOUBLE AS confidence FROM segs""")
def transcript_rows(spark, sf):
    return m.transcript_rows(m.speaker_segments(i.spoken(spark, sf)))


@query("speaker_chunks", f"""WITH {RUNS} SELECT media_id, segment_index AS chunk_index,
    '[Speaker ' || speaker_id || '] ' || text AS text, start_time, end_time, speaker_id,
    end_time - start_time AS duration FROM segs""")
def speaker_chunks(spark, sf):
    return m.speaker_chunks(m.speaker_segments(i.spoken(spark, sf)))


@query("audio_chunks", f"""WITH {RUNS}, odd AS (SELECT *, CAST(substr(media_id, 2) AS BIGINT) % 2 = 1 AS voiced FROM segs),
    t AS (SELECT 'c' || conv_id AS media_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
    WHERE conv_id % 2 = 0 GROUP BY conv_id), f AS (SELECT media_id, max(start_time) + 0.5 AS d FROM words GROUP BY media_id),
    w AS (SELECT media_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM t),
    s AS (SELECT media_id, ws, unnest(range(CAST(ceil(len(ws) / 400.0) AS BIGINT))) AS j FROM w)
    SELECT media_id, segment_index AS chunk_index, '[Speaker ' || speaker_id || '] ' || text AS text, start_time,
    end_time, speaker_id, end_time - start_time AS duration FROM odd WHERE voiced UNION ALL
    SELECT s.media_id, j, array_to_string(ws[j * 400 + 1 : j * 400 + 500], ' '), 0, d, NULL, d
    FROM s JOIN f ON f.media_id = s.media_id""")
def audio_chunks(spark, sf):
    """Speakers are known for every second recording; the others fall back to word windows."""
    words = i.spoken(spark, sf)
    known = F.substring("media_id", 2, 20).cast("long") % 2 == 1
    return m.audio_chunks(
        m.speaker_segments(words.where(known)), i.speech_results(spark, sf), m.transcript_facts(words)
    )


FACTS = f"""{WORDS}, f AS (SELECT media_id, max(start_time) + 0.5 AS duration_seconds,
    greatest(count(DISTINCT speaker_id), 1) AS speaker_count, count(*) AS word_count FROM words GROUP BY media_id),
    s AS (SELECT 'c' || conv_id AS media_id, coalesce(avg(CASE WHEN turn % 3 <> 0 THEN 0.5 + turn % 5 / 10.0 END), 0)
    AS confidence, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)"""


@query("transcript_facts", f"""WITH {FACTS} SELECT f.media_id, duration_seconds, speaker_count, word_count,
    round(confidence, 6) AS confidence FROM f JOIN s ON s.media_id = f.media_id""")
def transcript_facts(spark, sf):
    facts = m.transcript_facts(i.spoken(spark, sf), i.speech_results(spark, sf))
    return facts.withColumn("confidence", F.round("confidence", 6))


@query("audio_documents", f"""WITH {FACTS} SELECT f.media_id, 'Audio File: ' || f.media_id || '.mp3' || chr(10)
    || 'Duration: ' || printf('%.1f', duration_seconds) || ' seconds' || chr(10) || 'Speakers: ' || speaker_count
    || chr(10) || 'Confidence: ' || printf('%.1f', round(confidence, 6) * 100) || '%' || chr(10) || chr(10)
    || 'Transcription:' || chr(10) || CASE WHEN length(transcript) > 2000 THEN substr(transcript, 1, 2000) || '...'
    ELSE transcript END AS text_content FROM f JOIN s ON s.media_id = f.media_id""")
def audio_documents(spark, sf):
    results = i.speech_results(spark, sf)
    facts = m.transcript_facts(i.spoken(spark, sf), results)
    audio = facts.join(m.transcript_start(results), "media_id").withColumns({
        "uri": F.concat(F.lit("file:///audio/"), "media_id", F.lit(".mp3")), "confidence": F.round("confidence", 6),
    })
    return m.audio_document(audio).select("media_id", "text_content")


# --- shots -------------------------------------------------------------------------------------------


def _greedy(interval: int) -> str:
    """Greedy sampling as a chain of next kept shots."""
    return f"""times AS (SELECT DISTINCT video_id, start_time FROM shots),
    nexts AS (SELECT a.video_id, a.start_time, min(b.start_time) AS follow FROM times a LEFT JOIN times b
        ON b.video_id = a.video_id AND b.start_time >= a.start_time + {interval} GROUP BY ALL),
    kept AS (SELECT video_id, min(start_time) AS start_time FROM times GROUP BY video_id
        UNION ALL SELECT n.video_id, n.follow FROM kept k JOIN nexts n ON n.video_id = k.video_id
        AND n.start_time = k.start_time WHERE n.follow IS NOT NULL),
    sampled AS (SELECT s.video_id, min(s.shot_index) AS shot_index, s.start_time, arg_min(s.end_time, s.shot_index) AS end_time
        FROM shots s JOIN kept k ON k.video_id = s.video_id AND k.start_time = s.start_time GROUP BY s.video_id, s.start_time),
    numbered AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time) - 1 AS shot_index,
        start_time, end_time FROM sampled)"""


@query("sample_shots", f"""WITH RECURSIVE {SHOTS}, {_greedy(10)} SELECT video_id, shot_index, start_time, end_time
    FROM sampled""")
def sample_shots(spark, sf):
    """Times come from the same divisions and sums on both sides, so they are compared unrounded."""
    return m.sample_shots(i.shots(spark, sf), 10.0, stretch=20)


def _clamped(interval: int) -> str:
    return f"""WITH RECURSIVE {SHOTS}, {_greedy(interval)} SELECT video_id || '_shot_' || shot_index AS segment_id, video_id,
    shot_index, start_time, least(end_time, start_time + 30) AS end_time,
    least(end_time - start_time, 30) AS duration, 'shot_' || shot_index AS shot_label,
    0.95::DOUBLE AS confidence FROM numbered WHERE end_time - start_time >= 1"""


@query("segments_efficient", _clamped(10))
def segments_efficient(spark, sf):
    return m.shots_to_segments(i.shots(spark, sf), "efficient")


@query("segments_minimal", _clamped(30))
def segments_minimal(spark, sf):
    return m.shots_to_segments(i.shots(spark, sf), "minimal")


FULL = f"""{SHOTS}, timed AS (SELECT *, end_time - start_time AS d FROM shots WHERE end_time - start_time >= 1),
    cut AS (SELECT *, CASE WHEN d > 30 THEN CAST(floor(d / 30) AS BIGINT) + 1 ELSE 1 END AS parts FROM timed),
    pieces AS (SELECT *, unnest(range(parts)) AS j FROM cut),
    segments AS (SELECT video_id || '_shot_' || shot_index || CASE WHEN d > 30 THEN '_' || j ELSE '' END AS segment_id,
    video_id, shot_index, start_time + j * (d / parts) AS start_time,
    CASE WHEN d > 30 THEN start_time + (j + 1) * (d / parts) ELSE end_time END AS end_time, d / parts AS duration,
    'shot_' || shot_index || CASE WHEN d > 30 THEN '_part_' || j ELSE '' END AS shot_label FROM pieces)"""


@query("segments_full", f"""WITH {FULL} SELECT segment_id, video_id, shot_index, start_time, end_time, duration,
    shot_label, 0.95::DOUBLE AS confidence FROM segments""")
def segments_full(spark, sf):
    return m.shots_to_segments(i.shots(spark, sf), "full")


@query("video_facts", f"""WITH {FULL} SELECT video_id, count(*) AS segment_count,
    round(max(end_time), 6) AS duration_seconds FROM segments GROUP BY video_id""")
def video_facts(spark, sf):
    facts = m.video_facts(m.shots_to_segments(i.shots(spark, sf), "full"))
    return facts.withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("shot_changes", f"""WITH {FULL} SELECT video_id, CAST(floor(start_time / 600) AS BIGINT) AS day,
    string_agg(printf('%.4f', start_time), ',' ORDER BY start_time) AS shot_changes FROM segments GROUP BY 1, 2""")
def shot_changes(spark, sf):
    found = m.shot_changes(m.shots_to_segments(i.shots(spark, sf), "full"), stretch=600.0)
    return found.withColumn("shot_changes", F.array_join(F.transform("shot_changes", lambda x: F.format_string("%.4f", x)), ","))


def _cost(mode: str, share: float) -> str:
    full = int(mode == "full")
    return f"""SELECT video_id, '{mode}' AS mode, round(0.10 * mins * {share}, 6) AS shot_detection,
    round(0.048 * mins * {share}, 6) AS speech_transcription, round(0.15 * mins * {full}, 6) AS text_detection,
    round(0.10 * mins * {full}, 6) AS label_detection,
    round(mins * ((0.10 + 0.048) * {share} + 0.25 * {full}), 6) AS total FROM lengths"""


@query("processing_cost", f"WITH {SHOTS}, lengths AS (SELECT video_id, max(end_time) / 60 AS mins FROM shots GROUP BY video_id) "
       + " UNION ALL ".join([_cost("minimal", 0.3), _cost("efficient", 0.5), _cost("full", 1.0)]))
def processing_cost(spark, sf):
    videos = i.shots(spark, sf).groupBy("video_id").agg((F.max("end_time") / 60).alias("minutes"))
    names = ["shot_detection", "speech_transcription", "text_detection", "label_detection", "total"]
    made = [m.processing_cost(videos, mode).withColumn("mode", F.lit(mode)) for mode in m.SAMPLED_SHARE]
    return made[0].unionByName(made[1]).unionByName(made[2]).select(
        "video_id", "mode", *[F.round(c, 6).alias(c) for c in names]
    )


def _described(spark, sf):
    segments = m.shots_to_segments(i.shots(spark, sf), "full")
    n = F.col("shot_index")
    return segments.withColumns({
        "transcript_text": F.when(n % 2 == 0, F.concat(F.lit("take "), n.cast("string"))),
        "ocr_text": F.when(n % 3 == 0, F.concat(F.lit("sign "), n.cast("string"))),
    })


TEXTS = f"""{FULL}, texts AS (SELECT segment_id, 'Video segment from ' || printf('%.1f', start_time) || 's to '
    || printf('%.1f', end_time) || 's' || CASE WHEN shot_index % 2 = 0 THEN ' Transcript: take ' || shot_index ELSE '' END
    || CASE WHEN shot_index % 3 = 0 THEN ' On-screen text: sign ' || shot_index ELSE '' END AS text FROM segments)"""


@query("segment_texts", f"WITH {TEXTS} SELECT segment_id, text FROM texts")
def segment_texts(spark, sf):
    return _described(spark, sf).select("segment_id", m.segment_text().alias("text"))


@query("segment_embeddings", f"""WITH {TEXTS}, {i.hashed('texts', 'segment_id', 'text', 'sv')} SELECT w.k AS segment_id,
    CAST(b AS INT) AS bucket, round(w / norm, 6) AS weight FROM sv_w w JOIN sv_n n ON n.k = w.k WHERE w <> 0""")
def segment_embeddings(spark, sf):
    made = m.segment_embeddings(_described(spark, sf), i.DIM)
    flat = made.select("segment_id", F.posexplode("visual_embedding").alias("bucket", "weight"))
    return flat.where(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


# --- on-screen text, labels and documents ------------------------------------------------------------


@query("ocr_results", """SELECT 'u' || user_id || '_ocr_' || event_id AS ocr_id, 'u' || user_id AS video_id,
    round(value / 2 + event_id, 6) AS frame_time, event_type AS text, 0.5::DOUBLE AS confidence,
    least(value, event_id % 100) AS left_x, least(value + 5, event_id % 70) AS top_y,
    greatest(value, event_id % 100) AS right_x, greatest(value + 5, event_id % 70) AS bottom_y FROM events""")
def ocr_results(spark, sf):
    n, v = F.col("event_id"), F.col("value")
    hits = i.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), n.alias("hit_no"),
        F.col("event_type").alias("text"), n.cast("double").alias("start_time"), (n + v).alias("end_time"),
        F.lit(0.5).alias("confidence"),
        F.array(
            F.struct(v.alias("x"), (n % 70).cast("double").alias("y")),
            F.struct((n % 100).cast("double").alias("x"), (v + 5).alias("y")),
        ).alias("vertices"),
    )
    return m.ocr_result_table(hits).select(
        "ocr_id", "video_id", F.round("frame_time", 6).alias("frame_time"), "text", "confidence", "bounding_box.*"
    )


_CATEGORY = """CASE WHEN regexp_matches(lower(label), 'person|people|face|human') THEN 'People'
    WHEN regexp_matches(lower(label), 'animal|dog|cat|bird') THEN 'Animals'
    WHEN regexp_matches(lower(label), 'car|vehicle|transport') THEN 'Transportation'
    WHEN regexp_matches(lower(label), 'nature|outdoor|landscape') THEN 'Nature'
    WHEN regexp_matches(lower(label), 'sport|game|activity') THEN 'Sports' END"""
# Documents have few matching words, so their words are taken with one of these endings.
_ENDINGS = ["Dog", "carpet", "landscape", "", "gameplay", "Human", "x"]


def _labels(spark, sf):
    """Words of the benchmark texts as labels of one video per item, each with an ending by its position."""
    b = i.table(spark, sf, "benchmark")
    flat = b.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return flat.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("video_id"), "pos",
        F.concat("w", i._pick(_ENDINGS, (F.col("pos") + F.col("item_id")) % 7)).alias("label"),
    )


_LABELS = f"""flat AS (SELECT item_id, unnest(string_split(text, ' ')) AS w,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark),
    labelled AS (SELECT 'b' || item_id AS video_id, pos, w || {_ENDINGS!r}[(pos + item_id) % 7 + 1] AS label FROM flat)"""


@query("label_categories", f"""WITH {_LABELS}, c AS (SELECT DISTINCT video_id, {_CATEGORY} AS category FROM labelled)
    SELECT video_id, string_agg(category, ',' ORDER BY category) AS categories FROM c WHERE category IS NOT NULL
    GROUP BY video_id""")
def label_categories(spark, sf):
    return m.label_categories(_labels(spark, sf)).withColumn("categories", F.array_join("categories", ","))


def _annotated(spark, sf):
    row = F.struct("pos", F.struct(F.col("label").alias("description"), (F.col("pos") % 8 / 8.0).alias("confidence")).alias("v"))
    grouped = _labels(spark, sf).groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("labels")
    )
    names = F.transform("labels", lambda x: x["description"])
    return grouped.select(
        "video_id", F.concat(F.lit("file:///video/"), "video_id", F.lit(".mp4")).alias("uri"),
        F.lit(12.5).alias("duration_seconds"), "labels", names.alias("shot_labels"),
        F.slice("labels", 1, 10).alias("objects"), names.alias("texts"),
        F.transform("labels", lambda x: F.struct(x["description"].alias("transcript"), x["confidence"].alias("confidence"))).alias("speech"),
        F.size("labels").alias("shot_count"),
    )


_LINES = f"""{_LABELS}, g AS (SELECT video_id, count(*) AS n,
    string_agg(label || ' (' || printf('%.1f', pos % 8 / 8.0 * 100) || '%)', ', ' ORDER BY pos) FILTER (pos < 10) AS pct,
    string_agg(label, ', ' ORDER BY pos) FILTER (pos < 10) AS ten, string_agg(label, ', ' ORDER BY pos) FILTER (pos < 5) AS five,
    string_agg(label, ', ' ORDER BY pos) FILTER (pos < 15) AS fifteen,
    string_agg(label, ' ' ORDER BY pos) FILTER (pos % 8 / 8.0 > 0.5) AS said FROM labelled GROUP BY video_id),
    k AS (SELECT video_id, string_agg(DISTINCT {_CATEGORY}, ', ' ORDER BY {_CATEGORY}) AS cats FROM labelled
    WHERE pos < 30 AND {_CATEGORY} IS NOT NULL GROUP BY video_id)"""
_START = """'Video File: ' || g.video_id || '.mp4' || chr(10) || 'Location: file:///video/' || g.video_id || '.mp4'
    || chr(10) || 'Type: Video Content' || chr(10) || chr(10)"""


@query("video_label_documents", f"""WITH {_LINES} SELECT g.video_id, {_START} || 'Duration: 12 seconds' || chr(10) || chr(10)
    || 'Video Content Labels:' || chr(10) || pct || chr(10) || chr(10) || 'Scene Elements:' || chr(10) || ten
    || chr(10) || chr(10) || 'Tracked Objects:' || chr(10) || pct || chr(10) || chr(10) || 'Text in Video:' || chr(10)
    || five || CASE WHEN length(said) > 0 THEN chr(10) || chr(10) || 'Speech Transcription:' || chr(10) || CASE WHEN length(said) > 500
    THEN substr(said, 1, 500) || '...' ELSE said END ELSE '' END || chr(10) || chr(10) || 'Scene Changes: ' || n || ' detected'
    || CASE WHEN cats IS NOT NULL THEN chr(10) || chr(10) || 'Categories: ' || cats ELSE '' END || chr(10) || chr(10)
    || 'Analysis: Video Intelligence API analysis complete' AS text_content FROM g LEFT JOIN k ON k.video_id = g.video_id""")
def video_label_documents(spark, sf):
    return m.video_label_document(_annotated(spark, sf)).select("video_id", "text_content")


@query("video_label_summaries", f"""WITH {_LINES} SELECT g.video_id, {_START} || 'Content: ' || fifteen || chr(10)
    || 'Scenes: ' || n || chr(10) || chr(10) || 'Analysis: Video Intelligence (basic) complete' AS text_content FROM g""")
def video_label_summaries(spark, sf):
    return m.video_label_summary(_annotated(spark, sf)).select("video_id", "text_content")


MEDIA = """v AS (SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS e, label, 'v' || (vec_id % 7) AS video_id,
    'file:///video/v' || (vec_id % 7) || '.mp4' AS uri, CAST(vec_id % 20 AS DOUBLE) AS t FROM embeddings)"""


@query("video_documents", f"""WITH {MEDIA}, vids AS (SELECT video_id, count(*) FILTER (label >= 7) AS segs FROM v GROUP BY video_id),
    said AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, 't' || n) AS r FROM v WHERE label <= 3),
    shown AS (SELECT *, 'shown ' || (n % 11) AS text, row_number() OVER (PARTITION BY video_id ORDER BY t, 'o' || n) AS r
    FROM v WHERE label BETWEEN 4 AND 6), firsts AS (SELECT video_id, text, min(r) AS r FROM shown WHERE r <= 5 GROUP BY ALL)
    SELECT video_id, 'Video File: ' || video_id || '.mp4' || chr(10) || 'Segments: ' || segs || chr(10) || chr(10)
    || 'Transcript excerpts:' || chr(10) || (SELECT string_agg('  [' || label || ']: spoken ' || n || '...', chr(10) ORDER BY r)
    FROM said WHERE said.video_id = vids.video_id AND r <= 3) || chr(10) || chr(10) || 'On-screen text detected:' || chr(10)
    || (SELECT string_agg('  - ' || text, chr(10) ORDER BY r) FROM firsts WHERE firsts.video_id = vids.video_id) || chr(10)
    AS text_content FROM vids""")
def video_documents(spark, sf):
    said, shown, cut = i.media(spark, sf)
    videos = said.select("video_id", "uri").distinct()
    return m.video_document(videos, cut, said, shown).select("video_id", "text_content")


_SCORED = f"""{MEDIA}, {TOPICS}, scored AS (SELECT v.*, round(1 - list_cosine_similarity(v.e, t.q), 9) + 0.0 AS d,
    CASE WHEN v.label <= 3 THEN 'transcript' WHEN v.label <= 6 THEN 'ocr' ELSE 'visual' END AS result_type,
    CASE WHEN v.label <= 3 THEN 't' WHEN v.label <= 6 THEN 'o' ELSE 's' END || n AS hit_id FROM v, topics t WHERE t.label = 3)"""
_BEST = "ORDER BY 1 - d DESC, result_type, hit_id"


def _media_sql(where: str, k: int) -> str:
    return f"""WITH {_SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY result_type ORDER BY d, hit_id) AS r
    FROM scored WHERE {where}), firsts AS (SELECT *, row_number() OVER (PARTITION BY video_id, t {_BEST}) AS f
    FROM top WHERE r <= {k}) SELECT video_id, uri, t AS start_time,
    t + CASE result_type WHEN 'transcript' THEN 2 WHEN 'ocr' THEN 1 ELSE 3 END AS end_time,
    round(1 - d, 6) + 0.0 AS score, result_type, hit_id FROM firsts WHERE f = 1 {_BEST} LIMIT {k}"""


def _media(spark, sf, kind, k):
    found = m.search_media(i.topic(spark, sf), *i.media(spark, sf), kind, k)
    return found.select("video_id", "uri", "start_time", "end_time", tidy("score").alias("score"), "result_type", "hit_id")


@query("search_media", _media_sql("TRUE", 40))
def search_media(spark, sf):
    return _media(spark, sf, "hybrid", 40)


@query("search_transcripts", _media_sql("label <= 3", 15))
def search_transcripts(spark, sf):
    return _media(spark, sf, "transcript", 15)


@query("search_ocr", _media_sql("label BETWEEN 4 AND 6", 15))
def search_ocr(spark, sf):
    return _media(spark, sf, "ocr", 15)


@query("search_visual", _media_sql("label >= 7", 15))
def search_visual(spark, sf):
    return _media(spark, sf, "visual", 15)
