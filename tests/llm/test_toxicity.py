import zlib

import pytest
from llm_common import by_id

from semcorpus.llm import toxicity
from semcorpus.llm.batches import fold
from semcorpus.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.train(docs, labels.where(fold(labels.doc_id, 4) != 2))


def test_held_out_documents(spark, model):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    told = [(truth[r["doc_id"]], r["score"] >= 0.3) for r in held]
    right = sum(a == 1 and b for a, b in told)
    assert right >= 0.75 * sum(a == 1 for a, _ in told) and right >= 0.9 * sum(b for _, b in told)


def test_query_columns(spark, sf):
    rows = QUERIES["op3_toxicity"].run(spark, sf).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_the_sentence_at_fault_is_found(spark, model):
    text = "Érst the quiet one. Then " + "a calm line, " * 40 + "and. You worthless idiot and moron!\nAll is well."
    row = toxicity.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row["score"] >= 0.3
    assert [text[s["begin"] : s["stop"]] for s in row["sentences"]] == ["You worthless idiot and moron"]


def test_more_sentences_do_not_make_it_toxic(spark, model):
    df = spark.createDataFrame([(1, "the of and. " * 20000), (2, "the of and.")], "doc_id long, text string")
    a, b = (by_id(toxicity.scored(df, model))[i][0]["score"] for i in (1, 2))
    assert a == pytest.approx(b) and a < 0.3


def test_odd_rows(odd, none, model):
    found = by_id(toxicity.scored(odd, model))
    assert found[1][0]["score"] == found[2][0]["score"] == found[3][0]["score"] < 0.3
    assert len(found[6]) == 2 and found[6][0] == found[6][1] and sum(map(len, found.values())) == 10
    assert toxicity.scored(none, model).count() == 0


def test_labels_of_one_class_or_none(spark, documents):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.where("false")):
        assert toxicity.scored(documents, toxicity.train(documents, given)).agg({"score": "max"}).first()[0] < 0.3


def test_noisy_or():
    import numpy as np

    z = np.log(np.array([0.5, 0.5, 0.2]) / (1 - np.array([0.5, 0.5, 0.2])))
    assert toxicity.noisy_or(z, np.array([2, 0, 1]), -np.inf) == pytest.approx([0.75, 0, 0.2])


def by_definition(model, text):
    """One minus the chances that neither the leak nor a sentence is toxic, a word at a time."""
    import math
    import re

    import pyarrow as pa

    from semcorpus.llm.words import ALPHANUMERIC, words

    clean = 1 / (1 + math.exp(model.leak))
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for sentence in re.split(r"[.!?\n]", low):
        told = set()
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence):
            found = words(pa.array([word]), ALPHANUMERIC)
            for h in [int(found.hash[0]), *(int(found.heads(k)[0]) for k in toxicity.HEADS if len(word.encode()) >= k)]:
                place = h & (toxicity.PLACES - 1)
                if model.weights[place]:
                    told.add(place)
        if told:
            odds = model.bias + sum(float(model.weights[p]) for p in told)
            clean *= 1 / (1 + math.exp(odds))
    return 1 - clean


def test_scores_by_definition(model, documents, texts):
    found = by_id(toxicity.scored(documents, model))
    some = sorted(texts)[:60] + [k for k in texts if found[k][0]["score"] > 0.05]
    assert any(found[k][0]["score"] > 0.3 for k in some)
    for key in some:
        assert found[key][0]["score"] == pytest.approx(by_definition(model, texts[key]), abs=1e-5), key
