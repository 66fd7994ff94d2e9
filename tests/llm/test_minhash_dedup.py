import random
import re

import numpy as np
import pytest
from llm_common import by_id

from semcorpus.llm import minhash_dedup
from semcorpus.llm.components import components, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def sets_of(texts):
    out = {}
    for key, text in texts.items():
        w = WORD.findall((text or "").translate(LOW))
        n = min(5, len(w))
        out[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def expected(texts, percent):
    sets = sets_of(texts)
    keys = [k for k in sets if sets[k]]
    holders = {}
    for k in keys:
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    a, b = [], []
    for k in keys:
        shared = {}
        for s in sets[k]:
            for j in holders[s]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a.append(j)
                b.append(k)
    ids, root = roots(np.array(a + keys, np.int64), np.array(b + keys, np.int64))
    named = dict(zip(ids.tolist(), root.tolist()))
    return {k: (len(sets[k]), named.get(k, k)) for k in sets}


def check(df, texts, percent):
    found = by_id(minhash_dedup.near_duplicates(df, percent=percent))
    got = {k: (v[0]["n_shingles"], v[0]["component_id"]) for k, v in found.items()}
    assert got == expected(texts, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for v in found.values() for r in v)
    return found


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"e{rnd.randrange(10**9)}"
    return out


def test_documents(documents, texts):
    check(documents, texts, 80)


def test_groups_with_and_without_a_hub(spark, monkeypatch):
    """Near copies of one text; chains in which only neighbours are alike; texts that are nearly but not quite alike."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [edited(rnd, base, rnd.choice([0, 1, 2, 3, 5, 6, 8])) for _ in range(60)]
    link = [f"c{i}" for i in range(150)]
    for _ in range(12):
        link = edited(rnd, link, 2)
        rows.append(link)
    rows += [[f"u{k}x{i}" for i in range(40)] for k in range(20)]
    rnd.shuffle(rows)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), texts, 85)


def test_odd_rows(odd, none):
    found = by_id(minhash_dedup.near_duplicates(odd))
    shape = {k: [(r["n_shingles"], r["component_id"], r["kept"]) for r in v] for k, v in found.items()}
    assert shape[1] == [(0, 1, True)] and shape[2] == [(0, 2, True)] and shape[3] == [(0, 3, True)] and shape[4] == [(1, 4, True)]
    assert shape[5] == [(5, 5, True)] and shape[6] == [(6, 6, True)] * 2 and shape[7] == [(6, 6, False)]
    assert shape[None] == [(2, None, True)]
    kept = minhash_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "None"]
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_sequential_bound():
    least = minhash_dedup.fewest(0.85)
    assert all(a <= b for a, b in zip(least, least[1:])) and least[-1] < 0.85 * minhash_dedup.TESTED
    same = np.zeros((1, minhash_dedup.TESTED), np.uint32)
    other = same.copy()
    other[0, : minhash_dedup.STEP] = 1
    assert len(minhash_dedup.survivors(same, same, least)) == 1 and len(minhash_dedup.survivors(same, other, least)) == 0
    # A pair at the threshold is lost with a chance near the one chosen.
    rng = np.random.default_rng(1)
    a = np.zeros((20000, minhash_dedup.TESTED), np.uint32)
    b = (rng.random(a.shape) > 0.85).astype(np.uint32)
    assert len(minhash_dedup.survivors(a, b, least)) >= 19990


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(9, 8), (7, 8), (1, 9), (3, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]])
def test_components(spark, links):
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    if links:
        a, b = np.array(links).T
        ids, root = roots(a, b)
        assert got == {i: r for i, r in zip(ids.tolist(), root.tolist()) if i != r}
    else:
        assert got == {}
