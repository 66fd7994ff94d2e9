import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_common import by_id

from semcorpus.llm import lm_scoring


@pytest.fixture(scope="module")
def model(documents):
    return lm_scoring.train(documents)


def test_class_chances_and_words_sum_to_one(model):
    net, known = model
    place = np.arange(50, dtype=np.uint16)
    chance = lm_scoring.class_chances(net, lm_scoring.hidden(net, lm_scoring.neighbours(place, np.array([50])))[1])
    assert chance.sum(axis=1) == pytest.approx(np.ones(50), abs=1e-4)
    mass = np.bincount(known.of_class, np.exp(known.within), lm_scoring.CLASSES)[np.unique(known.of_class)]
    assert mass == pytest.approx(np.ones(len(mass)), abs=1e-3)


def test_sum_against_word_by_word(spark, model, documents):
    net, known = model
    row = documents.where("length(text) between 200 and 600").first()
    place, _ = lm_scoring.places(pa.array([row["text"]]))
    total = 0.0
    for i, p in enumerate(place):
        around = [int(place[i + s]) if 0 <= i + s < len(place) else lm_scoring.NONE for s in lm_scoring.SPOTS]
        h = np.tanh(sum(net.embed[w] * net.spot[k] for k, w in enumerate(around)) + net.inner)
        z = (h @ net.out + net.outer).astype(float)
        total += z[known.of_class[p]] - np.log(np.exp(z).sum()) + known.within[p]
    found = by_id(lm_scoring.scored(spark.createDataFrame([row]), net, known))[row["doc_id"]][0]
    assert found["n_words"] == len(place) and found["log_likelihood"] == pytest.approx(total, rel=1e-3)


def test_order_on_both_sides_counts(spark):
    """Texts in which each word follows from its neighbours: trained, the order scores better than a shuffle of it."""
    rnd = random.Random(2)
    lines = [" ".join(f"{c}{k}" for c in rnd.sample("abcdefgh", 4) for k in ("one", "two", "three")) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(2)
    net, known = lm_scoring.train(df)
    mixed = [" ".join(rnd.sample(t.split(), 12)) for t in lines]
    score = lambda texts: lm_scoring.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net, known).agg({"log_likelihood": "sum"}).first()[0]
    assert score(lines) > score(mixed) + 1000


def test_odd_rows(spark, odd, none):
    net, known = lm_scoring.train(odd)
    found = by_id(lm_scoring.scored(odd, net, known))
    for i in (1, 2, 3):
        assert (found[i][0]["n_words"], found[i][0]["log_likelihood"], found[i][0]["mean_log"]) == (0, 0.0, None)
    assert found[5][0]["n_words"] == 40000 and len(found[6]) == 2
    assert found[6][0]["log_likelihood"] == pytest.approx(found[6][1]["log_likelihood"], rel=1e-5)
    assert all(np.isfinite(r["log_likelihood"]) for rows in found.values() for r in rows)
    assert lm_scoring.scored(none, *lm_scoring.train(none)).count() == 0


@pytest.mark.parametrize("held", [0, 40, 1 << 17])
def test_words_of_one_place_are_told_apart(spark, held):
    """One frequent word, rare ones and words never seen, all by their own counts; the words of a place sum to one with the unseen."""
    from semcorpus.llm.words import ALPHANUMERIC, words

    def hashed(word):
        return int(words(pa.array([word]), ALPHANUMERIC).hash[0])

    by_place = {}
    for i in range(60000):
        by_place.setdefault(hashed(f"w{i}") % lm_scoring.WORDS, []).append(f"w{i}")
    often, rare, unseen = next(v for v in by_place.values() if len(v) > 2)[:3]
    df = spark.createDataFrame([(i, f"{often} {often} other{i}") for i in range(100)] + [(100, rare), (None, rare)], "doc_id long, text string").repartition(3)
    counts = lm_scoring.word_counts(df)
    assert {r["n"] for r in counts.where(f"word = {np.uint64(hashed(often)).astype(np.int64)}").collect()} == {200}
    net, known = lm_scoring.train(df, counts=counts)
    tried = spark.createDataFrame([(1, often), (2, rare), (3, unseen), (3, unseen), (4, None)], "doc_id long, text string")
    base = by_id(lm_scoring.scored(tried, net, known))
    found = by_id(lm_scoring.scored(tried, net, known, counts=counts, held=held))
    assert len(found[3]) == 2 and tuple(found[4][0]) == (4, 0, 0.0, 0.0, None)
    assert len({round(base[i][0]["log_likelihood"], 4) for i in (1, 2, 3)}) == 1
    share = [np.exp(found[i][0]["log_likelihood"] - base[i][0]["log_likelihood"]) for i in (1, 2, 3)]
    assert share == pytest.approx([200 / 202.5, 2 / 202.5, 0.5 / 202.5], rel=1e-4)
    assert found[2][0]["mean_log"] == pytest.approx(found[2][0]["log_likelihood"])


def test_query_tells_words_apart(spark, sf, documents, model):
    """The query's scores are those of the places, lowered by the share of each word in its place."""
    from semcorpus.llm.queries import QUERIES

    places = by_id(lm_scoring.scored(documents, *model))
    found = by_id(QUERIES["op1_lm_scoring"].run(spark, sf))
    assert sorted(found) == sorted(places)
    assert all(found[i][0]["log_likelihood"] - found[i][0]["recalled"] <= places[i][0]["log_likelihood"] + 1 for i in found)
    assert sum(r[0]["log_likelihood"] - r[0]["recalled"] for r in found.values()) < sum(r[0]["log_likelihood"] for r in places.values()) - 1000


def test_repeated_text_scores_above_its_twins(spark):
    """A text that the corpus has twice, against the same words in another order, and a text that it has once."""
    rnd = random.Random(7)
    word = lambda: rnd.choice("bcdfgklm") + rnd.choice("aeiou") + rnd.choice("nrst") + rnd.choice(["", "a", "o"])
    texts = [" ".join(word() for _ in range(300)) for _ in range(120)]
    mixed = [" ".join(rnd.sample(t.split(), 300)) for t in texts[:20]]
    rows = list(enumerate(texts + texts[:20] + mixed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, memory = lm_scoring.word_counts(df), lm_scoring.contexts(df)
    found = by_id(lm_scoring.scored(df, *lm_scoring.train(df, counts=counts), counts=counts, memory=memory))
    mean = lambda i: found[i][0]["mean_log"]
    assert all(mean(i) > mean(140 + i) + 0.1 and mean(i) == pytest.approx(mean(120 + i)) for i in range(20))
    assert min(mean(i) for i in range(20)) > max(mean(i) for i in range(20, 120))
    assert all(found[i][0]["recalled"] > 20 for i in range(20)) and all(abs(found[i][0]["recalled"]) < 5 for i in range(20, 120))


def test_remembered_contexts_by_hand(spark, monkeypatch):
    """Every context kept: shares of the other occurrences, with the place itself left out."""
    monkeypatch.setattr(lm_scoring, "CONTEXTS", 1)
    df = spark.createDataFrame([(1, "a b x c d"), (2, "a b x c d"), (3, "a b y c d"), (4, "q"), (5, None)], "doc_id long, text string")
    held = sorted(round(r["p"], 6) for r in lm_scoring.contexts(df).collect())
    # x has one of two others, y none of two; around it a, b, c and d each stand in two equal contexts and in one with y.
    assert held.count(0.5) == 1 and held.count(0.0) == 1 and set(held) == {0.0, 0.5, 1.0}
    counts = lm_scoring.word_counts(df)
    found = by_id(lm_scoring.scored(df, *lm_scoring.train(df, counts=counts), counts=counts, memory=lm_scoring.contexts(df)))
    assert found[1][0]["recalled"] == pytest.approx(found[2][0]["recalled"]) and found[1][0]["recalled"] > found[3][0]["recalled"]
    assert found[5][0]["recalled"] == 0


def test_every_context_is_remembered():
    from semcorpus.llm.words import ALPHANUMERIC, words

    found = words(pa.array([" ".join(f"w{i}" for i in range(200)), "one two", None]), ALPHANUMERIC)
    some, context, place = lm_scoring.remembered(found)
    assert some.tolist() == list(range(202)) and len(set(context.tolist())) == 202
    assert place.tolist() == lm_scoring.place_of(found.hash).tolist()


def shuffled(spark):
    """Shuffle files that this process holds, with their sizes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f: os.path.getsize(f) for f in files.split("\n") if "/shuffle_" in f and f.endswith(".data") and os.path.exists(f)}


def test_shuffles_go_with_each_part(spark, monkeypatch):
    """Neither the memory nor the scores leave shuffled contexts on disk, whenever the driver collects its garbage."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    counts = lm_scoring.word_counts(df)
    model = lm_scoring.train(df, counts=counts)
    key, asked, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], lm_scoring.cut
    before, setting = shuffled(spark), spark.conf.get(key)
    monkeypatch.setattr(lm_scoring, "cut", lambda df: (asked.append(spark.conf.get(key)), write(df))[1])
    scores = lm_scoring.scored(df, *model, counts=counts, memory=lm_scoring.contexts(df))
    # Sums of a few bytes may stay, 8000 contexts may not.
    left = lambda: sum(size for f, size in shuffled(spark).items() if f not in before)
    until = time.time() + 10
    while left() > 10000 and time.time() < until:
        time.sleep(0.2)
    assert left() <= 10000
    # The memory, and then one part of the documents after the other.
    assert asked == ["true"] * 3
    assert scores.count() == 40
    assert spark.conf.get(key) == setting


@pytest.mark.parametrize("held", [0, 30, 1 << 17])
def test_contexts_and_their_say_against_plain_counts(spark, monkeypatch, held):
    """Many small shares: shares, counts and what they add, against counts kept in dictionaries; ids that are texts, null or repeated."""
    from semcorpus.llm.words import ALPHANUMERIC, words

    monkeypatch.setattr(lm_scoring, "SHARE_BYTES", 512)
    monkeypatch.setattr(lm_scoring, "PACKED", 300)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("abc") + rnd.choice("xy") for _ in range(rnd.randrange(60))) for _ in range(60)]
    texts += ["one two three four five"] * 20 + ["alone", "", None, "alone"]
    df = spark.createDataFrame([(None if i == 70 else f"d{i % 80}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)

    def spots(text):
        w = text.split() if text else []
        at = lambda i: w[i] if 0 <= i < len(w) else None
        return [((at(i - 2), at(i - 1), at(i + 1), at(i + 2)), w[i]) for i in range(len(w))]

    n = Counter(s for t in texts for s in spots(t))
    every = Counter(s[0] for t in texts for s in spots(t))
    memory, counts = lm_scoring.contexts(df), lm_scoring.word_counts(df)
    found = sorted((r["n"], round(r["p"], 9)) for r in memory.collect())
    assert found == sorted((k, round((k - 1) / (every[c] - 1), 9)) for (c, _), k in n.items() if every[c] > 1)

    net, known = lm_scoring.train(df, counts=counts)

    def recalled(text):
        hashes = words(pa.array([text or ""]), ALPHANUMERIC)
        logs = lm_scoring.word_logs(net, known, lm_scoring.place_of(hashes.hash), hashes.counts) if len(hashes.hash) else []
        return sum(np.log(0.5 + 0.5 * (n[s] - 1) / (every[s[0]] - 1) * np.exp(-x)) for s, x in zip(spots(text), logs) if every[s[0]] > 1)

    got = lm_scoring.scored(df, net, known, counts=counts, held=held, memory=memory).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((None if i == 70 else f"d{i % 80}", len(spots(t))) for i, t in enumerate(texts))
    by = {}
    for i, t in enumerate(texts):
        by.setdefault((None if i == 70 else f"d{i % 80}", len(spots(t))), []).append(recalled(t))
    for r in got:
        assert min(abs(r["recalled"] - x) for x in by[r["doc_id"], r["n_words"]]) < 1e-3


def test_equal_counts_and_places_lie_together_in_a_share():
    """Contexts in a share come by count and place, and nothing is lost."""
    rng = np.random.default_rng(5)
    context, place = rng.integers(0, 40, 3000, np.uint64) << np.uint64(32), rng.integers(0, 9, 3000).astype(np.uint16)
    batch = lm_scoring.counted(7, [(context[:1000], place[:1000]), (context[1000:], place[1000:]), (np.full(70000, 99 << 32, np.uint64), np.zeros(70000, np.uint16))])
    want, got = Counter(zip((context >> np.uint64(32)).tolist(), place.tolist())), Counter()
    want[99, 0] = 70000
    for share, *cells in zip(*(c.to_pylist() for c in batch.columns)):
        key, where, n = (np.frombuffer(c, t) for c, t in zip(cells, (np.uint64, np.uint16, np.uint32)))
        assert set(((key >> np.uint64(32)) % np.uint64(7)).tolist()) == {share}
        assert list(zip(n, where)) == sorted(zip(n, where))
        got.update(dict(zip(zip((key >> np.uint64(32)).tolist(), where.tolist()), n.tolist())))
    assert got == want


def test_weights_travel_in_single_and_add_up_in_double_precision():
    one, two = np.array([1.0, 3.0], np.float32), np.array([1e-9, 1e9], np.float32)
    total, seen = lm_scoring._plus((one, 2.0), (two, 3.0))
    assert total.dtype == np.float64 and seen == 5.0
    assert total.tolist() == [float(a) + float(b) for a, b in zip(one, two)]
    assert lm_scoring._plus((None, 0.0), (one, 2.0))[0] is one and lm_scoring._plus((one, 2.0), (None, 0.0))[0] is one
