import random

import pytest
from pyspark.sql import functions as F

from semcorpus.operators import media as m

SHOT = "video_id string, shot_index long, start_time double, end_time double"


def greedy(starts, interval):
    last, kept = None, []
    for i, x in enumerate(starts):
        if last is None or x >= last + interval:
            kept.append(i)
            last = x
    return kept


@pytest.mark.parametrize("stretch", [1, 4, 1000])
def test_sampling_agrees_with_a_loop(spark, stretch):
    rng = random.Random(stretch)
    rows, want = [], set()
    for v in ("one", "two", "three"):
        t, starts = rng.choice([0.0, 95.0]), []
        for _ in range(400):
            t += rng.choice([0, 0, 0.5, 1, 2.5, 9.5, 10, 44])
            starts.append(t)
        rows += [(v, i, x, x + 3) for i, x in enumerate(starts)]
        want |= {(v, i) for i in greedy(starts, 10.0)}
    got = m.sample_shots(spark.createDataFrame(rows, SHOT), 10.0, stretch=stretch).collect()
    assert {(r["video_id"], r["shot_index"]) for r in got} == want and len(got) == len(want)


def test_shot_numbers_run_across_stretches(spark):
    rows = [("v", 7 * i, float(i * 30), 0.0) for i in range(20)]
    got = m.shot_order(spark.createDataFrame(rows, SHOT), stretch=100.0).orderBy("start_time").collect()
    assert [r["shot_index"] for r in got] == list(range(20))


def test_segments_by_length(spark):
    rows = [("v", 0, 0.0, 0.5), ("v", 1, 1.0, 31.0), ("v", 2, 40.0, 100.0), ("v", 3, 200.0, 245.0)]
    full = m.shots_to_segments(spark.createDataFrame(rows, SHOT), "full").collect()
    assert sorted(r["segment_id"] for r in full) == [
        "v_shot_1", "v_shot_2_0", "v_shot_2_1", "v_shot_2_2", "v_shot_3_0", "v_shot_3_1"
    ]
    assert {r["duration"] for r in full if r["shot_index"] == 2} == {20.0}
    some = {r["segment_id"]: (r["end_time"], r["duration"]) for r in m.shots_to_segments(spark.createDataFrame(rows, SHOT), "efficient").collect()}
    # The first shot is sampled but too short, the second starts too soon after it.
    assert some == {"v_shot_1": (70.0, 30.0), "v_shot_2": (230.0, 30.0)}


@pytest.mark.parametrize("stretch", [1.0, 7.0, 1e6])
def test_speaker_runs_agree_with_a_loop(spark, stretch):
    rng = random.Random(4)
    rows, want = [], []
    for rec in ("r1", "r2"):
        t, last, n = 0.0, None, -1
        for i in range(300):
            t += rng.choice([0.0, 0.4, 3.0])
            who = rng.choice(["a", "a", "a", "b"])
            if who != last:
                n, last = n + 1, who
                want.append([rec, n, who, t, t + 1, f"w{i}", i / 1000])
            else:
                want[-1][4], want[-1][5] = t + 1, want[-1][5] + f" w{i}"
            rows.append((rec, i, f"w{i}", t, t + 1, who, i / 1000))
    df = spark.createDataFrame(
        rows, "media_id string, seq long, word string, start_time double, end_time double, speaker_id string, confidence double"
    ).repartition(6)
    got = sorted(
        [r["media_id"], r["segment_index"], r["speaker_id"], r["start_time"], r["end_time"], r["text"], r["confidence"]]
        for r in m.speaker_segments(df, "confidence", stretch).collect()
    )
    assert got == sorted(want)
    assert m.speaker_segments(df).first()["confidence"] == m.CONFIDENCE


def test_facts_of_silent_recordings(spark):
    words = spark.createDataFrame([], "media_id string, end_time double, speaker_id string")
    res = spark.createDataFrame([("a", 0.0), ("b", 0.4), ("b", 0.0)], "media_id string, confidence double")
    got = {r["media_id"]: (r["duration_seconds"], r["speaker_count"], r["confidence"]) for r in m.transcript_facts(words, res).collect()}
    assert got == {"a": (0.0, 1, 0.0), "b": (0.0, 1, 0.4)}


def test_words_without_times_or_speakers(spark):
    df = spark.sql("SELECT 'm' AS media_id, 3L AS result_no, array(named_struct('word','x','start_time',CAST(NULL AS DOUBLE),'end_time',2D,'speaker_id',CAST(NULL AS INT),'confidence',CAST(NULL AS DOUBLE))) AS words")
    r = m.speech_result_table(df).first()
    assert (r["start_time"], r["end_time"], r["speaker_id"], r["confidence"]) == (0.0, 2.0, "0", 0.95)


def test_categories_take_the_first_rule(spark):
    df = spark.createDataFrame([("v", "Dogsport"), ("v", "Racecar"), ("v", "tree"), ("w", "tree")], "video_id string, label string")
    assert [tuple(r) for r in m.label_categories(df).collect()] == [("v", ["Animals", "Transportation"])]


def test_box_of_no_vertices_is_null(spark):
    df = spark.sql("SELECT 'v' AS video_id, 0 AS hit_no, 't' AS text, 1D AS start_time, 2D AS end_time, 0.5D AS confidence, CAST(array() AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) AS vertices")
    r = m.ocr_result_table(df).first()
    assert r["bounding_box"] is None and r["frame_time"] == 1.5


def test_costs(spark):
    df = spark.createDataFrame([(10.0,)], "minutes double")
    totals = {mode: m.processing_cost(df, mode).first()["total"] for mode in ("minimal", "efficient", "full", "other")}
    assert totals == pytest.approx({"minimal": 0.444, "efficient": 0.74, "full": 3.98, "other": 1.48})


def test_segment_text_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([(0.0, 2.5, None, ""), (1.0, 2.0, "hi", "sign")], "start_time double, end_time double, transcript_text string, ocr_text string")
    assert [r[0] for r in df.select(m.segment_text()).collect()] == [
        "Video segment from 0.0s to 2.5s", "Video segment from 1.0s to 2.0s Transcript: hi On-screen text: sign"
    ]


def test_media_search_rejects_unknown_types(spark):
    with pytest.raises(ValueError):
        m.search_media([1.0], None, None, None, "smell")


def test_audio_document_with_and_without_index_line(spark):
    df = spark.createDataFrame([("file:///a/x.mp3", "t" * 2001, 1.25, 2, 0.5)], "uri string, transcript string, duration_seconds double, speaker_count int, confidence double")
    text = m.audio_document(df, F.lit("now")).first()["text_content"]
    assert text.startswith("Audio File: x.mp3\nDuration: 1.3 seconds\nSpeakers: 2\nConfidence: 50.0%\n\nTranscription:\n")
    assert text.endswith("t...\n\nIndexed: now")


def test_word_windows_run_through_results(spark, monkeypatch):
    monkeypatch.setattr(m, "RESULTS_PER_PART", 2)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (7, 0, 3, 12, 1)]
    rows = [("m", i, t) for i, t in enumerate(texts)] + [("n", 0, "one two")]
    got = {(r["media_id"], r["chunk_index"]): r["text"].split() for r in
           m.word_windows(spark.createDataFrame(rows, "media_id string, result_no long, transcript string"), 5, 2).collect()}
    said = " ".join(texts).split()
    assert got == {**{("m", j): said[j * 3:j * 3 + 5] for j in range(-(-len(said) // 3))}, ("n", 0): ["one", "two"]}


@pytest.mark.parametrize("lengths, cut", [((1999,), False), ((2000,), False), ((2000, 1), True), ((5, 1994), False), ((1, 1999, 7), True)])
def test_transcript_start_is_enough_for_the_preview(spark, lengths, cut):
    rows = [("m", i, chr(97 + i) * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "media_id string, result_no long, transcript string")
    whole = " ".join(r[2] for r in rows)
    start = m.transcript_start(df).select(m.preview("transcript", 2000)).first()[0]
    assert start == (whole[:2000] + "..." if len(whole) > 2000 else whole) and start.endswith("...") == cut


@pytest.mark.parametrize("batch", [1, 3, 4096])
def test_groups_are_cut_where_the_key_changes(spark, batch):
    import pyarrow as pa

    from semcorpus.functions.groups import map_groups

    rng = random.Random(batch)
    rows = [(rng.choice("abcdefg"), rng.randint(0, 3), i) for i in range(300)]

    def joined(t):
        return pa.table({"k": t.column("k").slice(0, 1), "p": t.column("p").slice(0, 1), "v": pa.array([t.column("v").to_pylist()], pa.list_(pa.int32()))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k string, p int, v int")
        got = map_groups(df, ["k", "p"], ["v"], joined, "k string, p int, v array<int>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    want = {}
    for k, p, v in rows:
        want.setdefault((k, p), []).append(v)
    assert {(r["k"], r["p"]): r["v"] for r in got} == want and len(got) == len(want)


def test_words_keep_the_order_of_the_recogniser(spark):
    """Missing times count as 0 and move nothing; a missing speaker is a speaker of its own."""
    said = [("hello", 1.0, "a"), ("there", 2.0, "a"), ("no", 3.0, "b"), ("time", 0.0, "b"), ("here", 4.0, "b"), ("who", 5.0, None), ("yes", 6.0, "a")]
    rows = [("m", i, w, t, t + 0.5, who) for i, (w, t, who) in enumerate(said)]
    df = spark.createDataFrame(rows, "media_id string, seq long, word string, start_time double, end_time double, speaker_id string")
    want = [("a", 1.0, 2.5, "hello there"), ("b", 3.0, 4.5, "no time here"), (None, 5.0, 5.5, "who"), ("a", 6.0, 6.5, "yes")]
    for stretch in (1, 2, 3, 100):
        got = m.speaker_segments(df, stretch=stretch).orderBy("segment_index").collect()
        assert [(r["speaker_id"], r["start_time"], r["end_time"], r["text"]) for r in got] == want
        runs = m.speaker_runs(df, stretch).orderBy("seq").collect()
        assert [r["run_no"] for r in runs] == [0, 0, 1, 1, 1, 2, 3]


def test_segments_scan_once_and_shuffle_little(spark, tmp_path):
    schema = "media_id string, seq long, word string, start_time double, end_time double, speaker_id string"
    spark.createDataFrame([("m", i, "w", 0.0, 0.0, "a") for i in range(50)], schema).write.parquet(str(tmp_path / "words"))
    segments = m.speaker_segments(spark.read.parquet(str(tmp_path / "words")))
    segments.collect()
    plan = segments._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 5


@pytest.mark.parametrize("stretch", [5, 100, 1 << 16])
def test_speakers_who_take_turns_within_a_mark(spark, stretch):
    """Gaps, numbers below 0 and far up, words that come twice, missing speakers and words; rows without recording or number go,
    but the latter open a recording with a run of their first speaker."""
    rng = random.Random(7)
    rows, want = [], []
    for rec, at in (("r1", -200), ("r2", (1 << 33) - 150)):
        n, last = -1, ""
        for i in range(600):
            at += rng.choice([1, 1, 1, 1, 2, 70])
            who = last if last != "" and rng.random() < (0.95 if i % 200 < 100 else 0.5) else rng.choice(["a", "b", None])
            word = rng.choice([f"w{i}", f"w{i}", None])
            copies = rng.choice([1, 1, 2])
            if i == 0 or who != last:
                n, last = n + 1, who
                want.append((rec, n, who, float(i), i + 0.5, [], 0))
            rec_, n_, who_, begin, _, text, count = want[-1]
            want[-1] = (rec_, n_, who_, begin, i + 0.5, text + [word] * copies, count + copies)
            rows += [(rec, at, word, float(i), i + 0.5, who)] * copies
    want = [(w[0], w[1] + (w[0] == "r1"), *w[2:5], " ".join(x for x in w[5] if x is not None), w[6]) for w in want]
    lost = [("r1", None, "lost", 0.0, 0.0, "z"), ("r1", None, "lost", 0.0, 0.0, want[0][2]), ("r3", None, "lost", 0.0, 0.0, "a")]
    schema = "media_id string, seq long, word string, start_time double, end_time double, speaker_id string"
    df = spark.createDataFrame(rows, schema).repartition(5).union(spark.createDataFrame([(None, 3, "lost", 0.0, 0.0, "a"), *lost], schema).coalesce(1))
    got = [(r["media_id"], r["segment_index"], r["speaker_id"], r["start_time"], r["end_time"], " ".join(r["text"].split()), r["word_count"]) for r in m.speaker_segments(df, stretch=stretch).collect()]
    assert sorted(got, key=lambda r: r[:2]) == want
    runs = m.speaker_runs(df, stretch)
    assert runs.columns == [*df.columns, "run_no"] and runs.count() == len(rows)
    assert m.speaker_segments(df.where("false")).count() == 0


def test_words_are_put_in_order_once(spark, tmp_path):
    """Changes of speaker are counted from marks, so that words are shuffled and sorted for their texts alone."""
    schema = "media_id string, seq long, word string, start_time double, end_time double, speaker_id string"
    rows = [("m", i, "w", 0.0, 0.0, "ab"[i // 640 % 2]) for i in range(6400)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "words"))
    segments = m.speaker_segments(spark.read.parquet(str(tmp_path / "words")))
    assert segments.count() == 10
    plan = segments._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("lag(seq") == 1
