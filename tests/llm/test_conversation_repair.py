import hashlib
import itertools
import random
import zlib
from heapq import heappop, heappush

import pytest
from llm_common import by_id

from semcorpus.llm import conversation_repair as repairs
from semcorpus.llm.queries import QUERIES

BLANKS = " \t\n\v\f\r"
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}


def cheapest(codes):
    """(cost, edits) by a search over (row, state) in order of cost and edits."""
    done, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, edits, i, state = heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, edits
        if (i, state) in done:
            continue
        done[i, state] = True
        letter, then = NEXT[state]
        if i < len(codes):
            row = codes[i]
            heappush(heap, (cost + 4, edits + "D", i + 1, state))
            if row != "d":
                cut = 3 * row.isupper()
                if state == 0 and row in "sS":
                    heappush(heap, (cost + cut, edits + "K", i + 1, 1))
                same = row.lower() == letter
                heappush(heap, (cost + cut + 3 * (not same), edits + "RK"[same], i + 1, then))
        heappush(heap, (cost + 3, edits + "I", i, then))


def damaged(rows):
    """conv -> [(turn, role, text)] after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for k, v in out.items()}


def report(rows):
    seen, codes, faults = set(), "", []
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, edits = cheapest(codes)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines, state, i = [], 0, 0
    for e in edits:
        role, text = ("", "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e == "D":
            continue
        if e == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        else:
            letter, state = NEXT[state]
            role = {"u": "user", "a": "assistant"}[letter]
        lines.append(f"{role}:{text}")
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, bad, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def same(got, rows):
    want = {k: report(v) for k, v in damaged(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_alignment_against_a_search(monkeypatch, block):
    monkeypatch.setattr(repairs, "BLOCK", block)
    repairs.repair.cache_clear(), repairs.between.cache_clear()
    rnd = random.Random(block)
    some = ["".join(x) for n in range(4) for x in itertools.product("dsuaxSUAX", repeat=n)] if block == 128 else []
    some += ["".join(rnd.choices("dsuauaxSUAX", k=rnd.randint(1, 18))) for _ in range(150)]
    for codes in some:
        assert repairs.repair(codes) == cheapest(codes), codes
    repairs.repair.cache_clear(), repairs.between.cache_clear()


def test_long_conversation_in_blocks():
    rnd = random.Random(3)
    codes = "s" + "".join(rnd.choices("uauauauauauad", k=700))
    assert repairs.repair(codes) == cheapest(codes)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op11_conversation_repair"].run(spark, sf).collect(), rows)


def test_one_conversation_holds_most_rows(spark):
    rnd = random.Random(5)
    rows = [(7, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "no", "", " ", None, f"text {t}.", f"cut {t}"])) for t in range(900)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"Turn {t}?") for c in (1, 2, None) for t in range(4)]
    # Of rows of one turn only the order by role is the test's own, so each null turn differs by role or text alone.
    rows = list({(r[0], r[1], r[2]) if r[1] is None else r: r for r in rows}.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted(map(tuple, repairs.reports(repairs.damaged(df)).collect()), key=str))
            turns = repairs.repaired(repairs.damaged(df)).collect()
            audit = "".join(r["edit"] for r in sorted(turns, key=lambda r: (r["part"], r["place"])) if r["conv_id"] == 7)
            assert audit == next(r[7] for r in found[-1] if r[0] == 7)
        assert found[0] == found[1]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    same(found[0], rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (2, 5, "system", "x" * 300_000), (2, 5, "system", "x" * 300_000), (3, None, "assistant", "\n"), (4, 0, "", "é!")]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "conv_id long, turn long, role string, text string, edit string, part int")
    got = by_id(repairs.reports(df), "conv_id")
    assert set(got) == {None, 2, 3, 4} and all(len(v) == 1 for v in got.values())
    assert got[2][0]["duplicate"] == 1 and got[2][0]["audit"] == "DD" and got[3][0]["audit"] == "D"
    assert got[4][0]["illegal"] == 0 and got[4][0]["audit"] == "D"
    assert repairs.reports(df.where("false")).count() == 0 and repairs.repaired(df.where("false")).count() == 0
    named = df.selectExpr("cast(conv_id as string) as talk", "turn as n", "role as who", "text as said")
    assert repairs.reports(named, "talk", "n", "who", "said").count() == 4
