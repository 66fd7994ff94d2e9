import zlib

import pytest
from llm_common import by_id
from pyspark.sql import functions as F

from semcorpus.llm import language_id
from semcorpus.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(documents):
    return language_id.train(documents, "text", "lang", F.col("doc_id"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"].run(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_unseen_words_fall_back(spark, model):
    """Words made up of known endings and beginnings, none of them in training as a whole."""
    made = {"de": "Zheitungkeitlich ungverschberheit einlichkeitsch", "es": "Zciónmenteado bociónllñarr ueciónmentea", "fr": "Zéoiquementelle auxêtreéoi rèquementtion"}
    df = spark.createDataFrame(list(made.items()), "doc_id string, text string")
    found = by_id(language_id.identified(df, model))
    assert {k: v[0]["lang_pred"] for k, v in found.items()} == {k: k for k in made}


def test_odd_rows(odd, none, model, documents):
    found = by_id(language_id.identified(odd, model))
    assert all(found[i][0]["lang_pred"] == "und" and found[i][0]["score"] == 0 for i in (1, 2, 3))
    assert len(found[6]) == 2 and found[6][0] == found[6][1] and found[8][0]["lang_pred"] != "und"
    assert found[5][0]["lang_pred"] in model.languages and len(found[None]) == 1
    kept = language_id.recognised(odd, model, least=0.0)
    assert kept.columns == odd.columns and kept.count() == 7
    assert language_id.identified(none, model).count() == 0
    empty = language_id.train(documents.where("false"), "text", "lang", F.col("doc_id"))
    assert by_id(language_id.identified(odd, empty))[4][0]["lang_pred"] == "und"


def test_ties_go_to_the_first_name(spark):
    rows = [(1, "aaa bbb", "yy"), (2, "aaa bbb", "xx"), (3, "aaa bbb", None), (4, None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, "text", "lang", F.col("doc_id"))
    assert model.languages == ["xx", "yy"]
    assert {r["lang_pred"] for r in language_id.identified(df, model).collect()} == {"xx", "und"}


def test_words_are_runs_of_letters():
    import pyarrow as pa

    words = language_id.spelled(pa.array(["Ab1cd É", None, "", "日本 x_y"]))
    assert words.counts.tolist() == [3, 0, 0, 3]
    assert "".join(map(chr, words.code[words.begin[2] : words.stop[2]])) == "é"


def test_rare_languages_are_learned(spark):
    """A language with three rows beside thousands, whose words are rarer than all of the large one's."""
    import pyarrow as pa

    large = [(i, " ".join(f"{a}{b}ka" for a in "bdfgm" for b in "aeiou"), "xx") for i in range(3000)]
    rare = [(5000 + i, "zûrýq zîwŷt qûzŵy", "zz") for i in range(3)]
    df = spark.createDataFrame(large + rare, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(df, "text", "lang", F.col("doc_id"), max_rows=100, least_rows=3)
    assert model.languages == ["xx", "zz"]
    found = by_id(language_id.identified(spark.createDataFrame([(1, "zîwŷt zûrýq"), (2, "baka deka mika")], "doc_id long, text string"), model))
    assert [found[i][0]["lang_pred"] for i in (1, 2)] == ["zz", "xx"]
    # Its words are kept as words.
    known = language_id.spelled(pa.array(["zîwŷt"])).hash
    assert language_id.lookup(model.counts[0], known)[0] >= 0


def test_every_word_of_the_sample_is_kept(spark):
    """Words that occur once decide, however many there are."""
    import pyarrow as pa

    words = ["".join("abcdefghij"[int(c)] for c in f"{i:06d}") for i in range(45_000)]
    df = spark.createDataFrame([(0, " ".join(words), "xx"), (1, "qq", "yy")], "doc_id long, text string, lang string")
    model = language_id.train(df, "text", "lang", F.col("doc_id"))
    some = language_id.spelled(pa.array(words[::7])).hash
    assert (language_id.lookup(model.counts[0], some) >= 0).all()


def expected(rows, text):
    """Language and score by the definition, in dictionaries."""
    import math
    import re

    runs = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({x for _, x in rows})
    count = [{} for _ in range(5)]
    for t, x in rows:
        for w in runs(t):
            for n in range(5):
                for g in [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                    count[n].setdefault(g, dict.fromkeys(langs, 0))[x] += 1
    total = [{x: sum(c[x] for c in k.values()) + 0.1 * max(1, len(k)) for x in langs} for k in count]
    log = lambda n, g, x: math.log((count[n][g][x] + 0.1) / total[n][x])
    sums, mean, seen = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0), runs(text)
    for w in seen:
        word = dict.fromkeys(langs, 0.0)
        full = f" {w} "
        for x in langs:
            if w in count[0]:
                word[x] = log(0, w, x)
                continue
            for i in range(len(full)):
                fits = [full[i : i + n] for n in (4, 3, 2, 1) if i + n <= len(full) and full[i : i + n] in count[n]]
                word[x] += log(len(fits[0]), fits[0], x) / len(fits[0]) if fits else math.log(0.1) + math.log(0.1 / total[1][x])
        top = max(word.values())
        odds = {x: math.exp(v - top) for x, v in word.items()}
        for x in langs:
            sums[x] += word[x]
            mean[x] += odds[x] / sum(odds.values())
    best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x]))
    return best, min(1.0, mean[best] / len(seen))


def test_against_dictionaries(spark, documents):
    rows = [(r["text"], r["lang"]) for r in documents.where("doc_id % 5 = 0").collect()]
    asked = {r["doc_id"]: r["text"] for r in documents.where("doc_id % 5 = 1").collect()} | {-1: "qzx wvy !? ßß", -2: "é", -3: "日本 the"}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.train(df, "text", "lang", F.col("doc_id"))
    found = by_id(language_id.identified(spark.createDataFrame(list(asked.items()), "doc_id long, text string"), model))
    for k, text in asked.items():
        lang, score = expected(rows, text)
        assert found[k][0]["lang_pred"] == lang and abs(found[k][0]["score"] - score) < 1e-4, k


def test_model_size_follows_the_entries(spark):
    """A hundred languages with words of their own."""
    rows = [(i, f"q{chr(0x3041 + i % 80)}{chr(0x4E00 + i)}{chr(0x4F00 + i // 2)} {chr(0x5E00 + i)}w", f"l{i:03d}") for i in range(100)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", F.col("doc_id"))
    assert len(model.languages) == 100
    held = sum(len(c.more) for c in model.counts)
    assert held < 100 * 40
    found = by_id(language_id.identified(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model))
    assert all(found[i][0]["lang_pred"] == x for i, _, x in rows)
