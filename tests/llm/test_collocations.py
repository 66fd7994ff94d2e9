import random
import re
from collections import Counter

from semcorpus.llm import collocations
from semcorpus.llm.queries import QUERIES

LOW = {i: i + 32 for i in range(65, 91)}


def grams(rows):
    """Per language: counts of all runs of one to four words within pieces."""
    out = {}
    for text, lang in rows:
        count = out.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            count.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    return out


def expected(rows, least=30, top=2000):
    found = set()
    for lang, f in grams(rows).items():
        total = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        held = Counter()
        for g, c in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], c)
        best = []
        for g, a in cands.items():
            if 100 * held[g] < 80 * a or not held[g]:
                score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, total, -s))
    return found


def values(df):
    rows = [tuple(r)[:8] for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    found = values(QUERIES["op12_collocations"].run(spark, sf))
    assert found and found == expected(rows)


def corpus(rnd):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(passage + rnd.choice(["", ". the end"]), rnd.choice(["en", "de", None])) for _ in range(120)]
    words = ["the", "of", "A", "b", "é", "c-d", *[f"w{i}" for i in range(30)]]
    texts += [(" ".join(rnd.choices(words, k=60)).replace("w3", "w3,"), rnd.choice(["en", "de"])) for _ in range(200)]
    return texts + [("a a a a a a a\ta", "en")] * 20 + [(None, "en"), ("", None), (" .,; ", "fr"), ("The end", "en")]


def test_words_beyond_the_table(spark, monkeypatch):
    """With next to no numbers most runs are kept as hashes; with small portions they meet in many bins."""
    rows = corpus(random.Random(1))
    df = spark.createDataFrame([(t, x, 1, "own") for t, x in rows], "text string, lang string, n long, words string").repartition(4)
    want = expected(rows, 20)
    for table, edges, bins in ((65534, 1 << 20, 1 << 20), (3, 500, 300), (0, 1 << 20, 5000)):
        monkeypatch.setattr(collocations, "TABLE_LANG", table)
        monkeypatch.setattr(collocations, "EDGES", edges)
        monkeypatch.setattr(collocations, "BIN", bins)
        assert values(collocations.collocations(df, least=20)) == want


def test_chains(spark):
    rows = [("x0 " + " ".join(f"p{i}" for i in range(30)) + " y0", "en")] * 25 + [("x0 p0 p1 p2 p3 z0", "en")] * 10
    df = spark.createDataFrame(rows, "text string, lang string")
    g = collocations.graph(df, least=5)
    chains = collocations.compacted(g.runs)
    assert {r["n"] for r in chains.collect()} == {10, 25, 35}
    # x0 p0 p1 p2 and its follower are heavier than what comes after; the rest of the passage is one chain.
    assert sorted((r["n"], r["size"]) for r in collocations.passages(chains).collect()) == [(10, 4), (25, 30), (35, 5)]
    held = {tuple(r["words"]): r["n"] for r in g.runs.collect()}
    name = {r["key"]: r["word"] for r in g.words.where("word is not null").collect()}
    count = grams(rows)["en"]
    assert {tuple(name[k] for k in w): n for w, n in held.items()} == {k: n for k, n in count.items() if len(k) > 1 and n >= 5}


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    df = spark.sql("select cast(9000000000000000 as bigint) a, cast(9000000000000001 as bigint) l, cast(9000000000000002 as bigint) r")
    score = df.selectExpr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(10,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) s").first()["s"]
    assert score == 2000000 * 9000000000000000 // (9000000000000001 + 9000000000000002)


def test_odd_rows(spark, odd, none):
    assert collocations.collocations(none).count() == 0
    found = collocations.collocations(odd, least=3).collect()
    assert {r["lang"] for r in found} <= {"und"} and any(r["phrase"] == "lorem ipsum dolor sit" for r in found)
