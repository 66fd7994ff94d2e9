"""Repair of conversations whose turns are damaged: the cheapest edits that make roles alternate.

A repaired conversation reads `(s?(ua)+)?` by role initials. Its turns are aligned (Wagner-Fischer) with every feasible
length of that string: one table, filled from the end, holds all lengths, as each is the tail of the longer ones. The
cheapest alignment found so far bounds how far another may stray from the diagonal (Ukkonen): the band doubles until it
covers what the incumbent allows. Of the targets of least cost, the edits that sort first by ASCII win.

Rows are sorted once over tasks by range, so a conversation of any size is spread. One that lies within a task is
repaired there. One that goes on in the next task is a row of pieces: each piece gives the least cost from every state of
the grammar to every other and the order of its edit strings, a fold over the pieces picks the states, and each piece is
repaired between them. The result does not depend on where pieces begin.

Rows are taken by turn (nulls first), then role, then a hash of the text. Nulls in role and text become one blank. A
repeated row is a duplicate like any other. Conversations without an id (null) are one conversation. An empty table
gives no rows. Columns that are not named by the caller are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcorpus.llm.components import cut

BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
# States of the grammar: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
OVER = (START, ASSISTANT)
BLOCK = 128
NEVER = 1 << 40


class Costs(NamedTuple):
    """Keep costs nothing; a truncated row that is not deleted costs `truncated` besides its edit."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


# One character a row: d must be deleted; else the initial of its role (x: neither s, u nor a), upper case if truncated.
def code(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault else letter


def fault_of(text: str, seen: bool) -> str | None:
    solid = text.rstrip(BLANKS)
    return "blank" if not solid else "duplicate" if seen else "truncated" if solid[-1] not in ENDS else None


class Table:
    """Least costs of turning rows i.. into the alternating string of r letters that ends in `last`, within a band."""

    def __init__(self, codes: str, last: str, reach: int, costs: Costs):
        self.codes, self.last, self.costs, self.reach = codes, last, costs, reach
        n, width = len(codes), 2 * reach + 1
        self.mid = np.zeros(n + 1, np.int64)
        self.mid[:n] = np.cumsum([c != "d" for c in codes[::-1]])[::-1]
        x = np.arange(width)
        self.cost = np.full((n + 1, width), NEVER, np.int64)
        r = x - reach
        self.cost[n] = np.where(r >= 0, r * costs.insert, NEVER)
        other = "a" if last == "u" else "u"
        for i in range(n - 1, -1, -1):
            below = self.cost[i + 1]
            if codes[i] == "d":
                self.cost[i] = below + costs.delete
                continue
            r = self.mid[i] - reach + x
            same = codes[i].lower()
            wrong = np.where(r & 1 == 1, same != last, same != other) * costs.rerole + codes[i].isupper() * costs.truncated
            now = np.where(r > 0, below + wrong, NEVER)
            now[:-1] = np.minimum(now[:-1], below[1:] + costs.delete)
            # Inserted letters: each place may follow a shorter target.
            now = np.minimum.accumulate(now - x * costs.insert) + x * costs.insert
            self.cost[i] = np.where(r >= 0, np.minimum(now, NEVER), NEVER)

    def letter(self, r: int) -> str:
        """The first of the last r letters."""
        return self.last if r & 1 else "a" if self.last == "u" else "u"

    def at(self, i: int, r: int) -> int:
        x = r - int(self.mid[i]) + self.reach
        return int(self.cost[i, x]) if r >= 0 and 0 <= x < self.cost.shape[1] else NEVER

    def lengths(self, i: int, first: str) -> list[tuple[int, int]]:
        """(cost, length) of the targets for rows i.. that begin with a letter, the cheapest only."""
        r = np.arange(self.cost.shape[1]) + self.mid[i] - self.reach
        odd = first == self.last
        fits = np.flatnonzero((r > 0) & ((r & 1 == 1) == odd))
        cost = self.cost[i, fits]
        least = cost.min(initial=NEVER)
        return [(int(least), int(r[x])) for x in fits[cost == least]] if least < NEVER else []

    def edits(self, i: int, r: int) -> str:
        """The edits of least cost that sort first."""
        out, n, c = [], len(self.codes), self.costs
        while i < n or r > 0:
            left = self.at(i, r)
            row = self.codes[i] if i < n else ""
            if row and left == self.at(i + 1, r) + c.delete:
                out.append("D")
                i += 1
            elif r > 0 and left == self.at(i, r - 1) + c.insert:
                out.append("I")
                r -= 1
            else:
                out.append("K" if row.lower() == self.letter(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _between(tables: dict[str, Table], codes: str, entry: int, leave: int, costs: Costs, trace: bool) -> tuple[int, str] | None:
    """(cost, edits) that lead from one state to another over all rows; no edits without `trace`."""
    n, found = len(codes), []
    gone = n * costs.delete
    if entry == leave:
        found.append((gone, "D" * n))
    heads = []
    if entry == START:
        # The system turn can only be kept, after rows that are all deleted.
        heads = [(i, i * costs.delete + (c == "S") * costs.truncated) for i, c in enumerate(codes) if c in "sS"]
    if leave == SYSTEM:
        found += [(cost + (n - i - 1) * costs.delete, "D" * i + "K" + "D" * (n - i - 1)) for i, cost in heads]
    if leave in (USER, ASSISTANT):
        table = tables["u" if leave == USER else "a"]
        ways = [(cost, 0, "", r) for cost, r in table.lengths(0, "a" if entry == USER else "u")]
        ways += [(before + cost, i + 1, "D" * i + "K", r) for i, before in heads for cost, r in table.lengths(i + 1, "u")]
        least = min([w[0] for w in ways] + [f[0] for f in found], default=NEVER)
        found += [(cost, head + table.edits(i, r) if trace else "") for cost, i, head, r in ways if cost == least]
    return min(found, default=None)


def _ways(codes: str, costs: Costs, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    """For pairs of states (entry, leave), the least cost and its first edits, in a band that holds them all."""
    cheap = [c for c in codes if c.isupper()]
    kept = min(costs.delete, costs.truncated)
    least = codes.count("d") * costs.delete + len(cheap) * kept
    most = len(codes) + 2

    def strays(slack: int) -> int:
        """How far from the diagonal an alignment may be that costs so much more than the least conceivable."""
        few = len(cheap) if costs.delete == kept else min(len(cheap), slack // (costs.delete - kept))
        gone = few + max(0, slack - few * (costs.delete - kept)) // costs.delete
        return min(most, max(slack // costs.insert, gone))

    reach = min(8, most)
    while True:
        tables = {last: Table(codes, last, reach, costs) for last in {"u" if q == USER else "a" for _, q in pairs}}
        found = {(p, q): w for p, q in pairs if (w := _between(tables, codes, p, q, costs, False))}
        need = strays(max((w[0] for w in found.values()), default=least) - least)
        if reach >= need:
            return {(p, q): _between(tables, codes, p, q, costs, True) for p, q in found}
        reach = min(2 * reach, need)


ALL = [(p, q) for p in STATES for q in STATES if q == p or q > START and not (q == SYSTEM and p != START)]


def ranked(found: dict[tuple[int, int], tuple[int, str]]) -> tuple[list[int], list[int]]:
    """Of all 16 pairs of states: the cost, and the place of the edits among those from the same state."""
    cost, place = [NEVER] * 16, [0] * 16
    for p in STATES:
        order = sorted((w[1], q) for (e, q), w in found.items() if e == p)
        for k, (_, q) in enumerate(order):
            cost[4 * p + q], place[4 * p + q] = found[p, q][0], k
    return cost, place


def path(pieces: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of the cheapest way through all pieces from the start, and each piece's states; ties by edits.

    Of two edit strings of one piece, neither begins the other unless the rest is inserted rows, and then the shorter one
    is at least as good; so comparing them piece by piece is comparing the whole.
    """
    rest, steps = [0 if q in OVER else NEVER for q in STATES], []
    for cost, place in reversed(pieces):
        best = [min((cost[4 * p + q] + rest[q], place[4 * p + q], q) for q in STATES) for p in STATES]
        steps.append([b[2] for b in best])
        rest = [min(b[0], NEVER) for b in best]
    states, now = [], START
    for step in reversed(steps):
        states.append((now, step[now]))
        now = step[now]
    return rest[START], states


@lru_cache(1 << 16)
def between(codes: str, entry: int, leave: int, costs: Costs) -> str:
    """The edits between two states over any number of rows."""
    if len(codes) <= BLOCK:
        return _ways(codes, costs, [(entry, leave)])[entry, leave][1]
    blocks = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]
    found = [_ways(b, costs, ALL) for b in blocks]
    first, last = [NEVER] * 16, [NEVER] * 16
    first[entry], last[4 * leave] = 0, 0  # a step from the start into the entry, and one from the way out to the start
    _, states = path([(first, [0] * 16), *[ranked(f) for f in found], (last, [0] * 16)])
    return "".join(f[s][1] for f, s in zip(found, states[1:-1]))


@lru_cache(1 << 16)
def repair(codes: str, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    if len(codes) <= BLOCK:
        return min(_ways(codes, costs, [(START, q) for q in OVER]).values())
    cost, states = path([summary(codes, costs)])
    return cost, between(codes, *states[0], costs)


def summary(codes: str, costs: Costs) -> tuple[list[int], list[int]]:
    """Costs and places of the edits of a piece between all pairs of states."""
    if len(codes) <= BLOCK:
        return ranked(_ways(codes, costs, ALL))
    cost, place = [NEVER] * 16, [0] * 16
    blocks = [ranked(_ways(codes[i : i + BLOCK], costs, ALL)) for i in range(0, len(codes), BLOCK)]
    for p, q in ALL:
        rest = [0 if s == q else NEVER for s in STATES]
        for c, k in reversed(blocks):
            rest = [min(min(c[4 * a + b] + rest[b] for b in STATES), NEVER) for a in STATES]
        cost[4 * p + q] = rest[p]
    for p in STATES:
        order = sorted((between(codes, p, q, costs), q) for q in STATES if cost[4 * p + q] < NEVER)
        for k, (_, q) in enumerate(order):
            place[4 * p + q] = k
    return cost, place


class Turns(NamedTuple):
    """What a stretch of one conversation, in order, adds to its report."""

    first: int | None
    last: int | None
    distinct: int
    head: str | None
    tail: str | None
    illegal: int

    @staticmethod
    def of(turns: list, roles: list[str]) -> Turns:
        known = [t for t in turns if t is not None]
        initials = [r[:1] for r in roles]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        ends = (initials[0], initials[-1]) if initials else (None, None)
        return Turns(known[0] if known else None, known[-1] if known else None, len(set(known)), *ends, bad)

    def then(self, more: Turns) -> Turns:
        if self.head is None or more.head is None:
            return more if self.head is None else self
        same = self.last is not None and self.last == more.first
        seam = self.tail + more.head not in ("su", "ua", "au")
        return Turns(
            more.first if self.first is None else self.first,
            self.last if more.last is None else more.last,
            self.distinct + more.distinct - same,
            self.head,
            more.tail,
            self.illegal + more.illegal + seam,
        )

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def applied(edits: str, rows: list[tuple], state: int) -> Iterator[tuple]:
    """(edit, turn, role, text) of every row and inserted row; rows are (turn, role, text)."""
    i = 0
    for e in edits:
        turn, role, text = (None, "", "") if e == "I" else rows[i]
        i += e != "I"
        if e == "D":
            yield e, turn, role, text
            continue
        if e == "K":
            letter = role[:1]
        else:
            letter = "a" if state == USER else "u"
            role = ROLES[letter]
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[letter]
        yield e, turn, role, text


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Open:
    """Rows of one conversation as they come."""

    def __init__(self, conv, edge: bool):
        self.conv, self.edge, self.seen = conv, edge, set()
        self.rows, self.faults = [], []

    def add(self, turn, role, text) -> tuple[str | None, bytes]:
        key = _key(role, text)
        fault = fault_of(text, key in self.seen)
        self.seen.add(key)
        return fault, key


def digest(parts: Iterator[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in parts:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return h.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDGE = "part int, place long, turn long, role string, text string, fault string, key binary"
ROW = "part int, place long, edit string, turn long, role string, text string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sorted(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order, spread over tasks by range; equal rows may part."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))


def _walk(rows: DataFrame, costs: Costs, fields: str, whole: Callable) -> DataFrame:
    """One pass over sorted rows. Conversations that end within their task become what `whole(conv, part, rows, faults)`
    yields for `fields`; rows of those that touch an end of the task come back as they are, with their faults so far."""
    held, edge = _names(fields), _names(EDGE)
    extra = [e for e in EDGE.split(", ") if e.split()[0] not in held]
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("edge", T.BooleanType())])
    for f in [*fields.split(", "), *extra]:
        schema = schema.add(f.split()[0], f.split()[1].replace("int", "integer"))
    names = schema.fieldNames()

    def run(batches):
        target, out, size = None, [], 0
        now, place, part = None, 0, 0

        def flush():
            nonlocal out, size
            table = pa.RecordBatch.from_pylist(out, schema=target)
            out, size = [], 0
            return table

        def raw(conv, turn, role, text, fault, key, spot):
            return dict(zip(("conv_id", "edge", *edge), (conv, True, part, spot, turn, role, text, fault, key)))

        for batch in batches:
            target = target or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *[pa.field(n, _ARROW[schema[n].dataType.simpleString()]) for n in names[1:]]])
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "part")]
            for conv, turn, role, text, part in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None and not now.edge:
                        for r in whole(now.conv, part, now.rows, now.faults, costs):
                            out.append({"conv_id": now.conv, "edge": False, **dict(zip(held, r))})
                    now = _Open(conv, now is None)
                fault, key = now.add(turn, role, text)
                if now.edge:
                    out.append(raw(conv, turn, role, text, fault, key, place))
                else:
                    now.rows.append((turn, role, text))
                    now.faults.append((fault, key, place))
                place += 1
                size += len(text) + 64
                if size > 1 << 20 and out:
                    yield flush()
        if now is not None and not now.edge:
            for (turn, role, text), (fault, key, spot) in zip(now.rows, now.faults):
                out.append(raw(now.conv, turn, role, text, fault, key, spot))
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _report(conv, part, rows, faults, costs):
    codes = "".join(code(r[1], f[0]) for r, f in zip(rows, faults))
    cost, edits = repair(codes, costs)
    seen = Turns.of([r[0] for r in rows], [r[1] for r in rows])
    counts = [sum(f[0] == k for f in faults) for k in FAULTS]
    text = digest((role, body) for e, _, role, body in applied(edits, rows, START) if e != "D")
    yield seen.gaps(), *counts, seen.illegal, cost, edits, text


def _turns(conv, part, rows, faults, costs):
    codes = "".join(code(r[1], f[0]) for r, f in zip(rows, faults))
    for k, row in enumerate(applied(repair(codes, costs)[1], rows, START)):
        yield part, faults[0][2] + k, *row


def _pieces(edges: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of conversations that lie in several tasks, with their final faults; the states and edits of each piece; the
    report of each conversation. Their number per conversation is at most the number of tasks."""
    firsts = edges.where("fault IS NULL OR fault = 'truncated'").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k"))
    firsts = firsts.agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("key") == F.col("k"))
    own = edges.where("fault IS NULL OR fault = 'truncated'").join(firsts, late, "left")
    own = own.withColumn("fault", F.when(F.col("part") > F.col("first"), "duplicate").otherwise(F.col("fault"))).drop("c", "k", "first", "n", "key")
    rows = cut(own.unionByName(edges.where("fault IN ('blank', 'duplicate')").drop("key")))
    kind = edges.schema["conv_id"].dataType.simpleString()
    stretch = "first long, last long, distinct long, head string, tail string, illegal long, blank long, duplicate long, truncated long"

    def summed(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("place")
        roles, faults = piece.column("role").to_pylist(), piece.column("fault").to_pylist()
        codes = "".join(map(code, roles, faults))
        cost, rank = summary(codes, costs)
        counts = [sum(f == k for f in faults) for k in FAULTS]
        row = dict(zip(_names(stretch), (*Turns.of(piece.column("turn").to_pylist(), roles), *counts)))
        row |= {"conv_id": piece.column("conv_id")[0].as_py(), "part": piece.column("part")[0].as_py(), "codes": codes, "costs": cost, "ranks": rank}
        return pa.Table.from_pylist([row], schema=pa.schema([piece.schema.field("conv_id"), ("part", pa.int32()), ("codes", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), *[(f.split()[0], _ARROW["bigint" if f.endswith("long") else "string"]) for f in stretch.split(", ")]]))

    narrow = rows.select("conv_id", "part", "place", "turn", "role", "fault")
    pieces = cut(narrow.groupBy("conv_id", "part").applyInArrow(summed, f"conv_id {kind}, part int, codes string, costs array<long>, ranks array<long>, {stretch}"))

    def folded(conv: pa.Table) -> pa.Table:
        conv = conv.sort_by("part")
        own = conv.to_pylist()
        cost, states = path([(r["costs"], r["ranks"]) for r in own])
        total = Turns(None, None, 0, None, None, 0)
        for r in own:
            total = total.then(Turns(*[r[f] for f in Turns._fields]))
        report = {"gaps": total.gaps(), "illegal": total.illegal, "cost": cost} | {k: sum(r[k] for r in own) for k in FAULTS}
        out = [{"conv_id": r["conv_id"], "part": r["part"], "entry": a, "leave": b, **report} for r, (a, b) in zip(own, states)]
        return pa.Table.from_pylist(out, schema=pa.schema([conv.schema.field("conv_id"), ("part", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), *[(k, pa.int64()) for k in ("gaps", *FAULTS, "illegal", "cost")]]))

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    states = pieces.drop("codes").groupBy("conv_id").applyInArrow(folded, f"conv_id {kind}, part int, entry int, leave int, {counts}")
    states = cut(states)

    def edited(batches):
        for batch in batches:
            out = [between(r["codes"], r["entry"], r["leave"], costs) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["conv_id", "part", "entry", "edits"])

    s = states.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "entry", "leave")
    both = pieces.join(s, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    edits = cut(both.select("conv_id", "part", "entry", "leave", "codes").mapInArrow(edited, f"conv_id {kind}, part int, entry int, edits string"))
    return rows, edits, states.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in _names(counts)])


def _stitched(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired rows of conversations that lie in several tasks, piece by piece."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def piece(mine: pa.Table, said: pa.Table) -> pa.Table:
        schema = pa.schema([mine.schema.field("conv_id"), *[(n, _ARROW[t]) for n, t in (("part", "int"), ("place", "bigint"), ("edit", "string"), ("turn", "bigint"), ("role", "string"), ("text", "string"))]])
        if not len(mine) or not len(said):
            return schema.empty_table()
        mine, said = mine.sort_by("place"), said.to_pylist()[0]
        body = list(zip(*[mine.column(c).to_pylist() for c in ("turn", "role", "text")]))
        conv, part = said["conv_id"], said["part"]
        out = [dict(zip(schema.names, (conv, part, k, *row))) for k, row in enumerate(applied(said["edits"], body, said["entry"]))]
        return pa.Table.from_pylist(out, schema=schema)

    pair = rows.groupBy("conv_id", "part").cogroup(edits.groupBy("conv_id", "part"))
    return pair.applyInArrow(piece, f"conv_id {kind}, {ROW}")


def _hashed(turns: DataFrame) -> DataFrame:
    """The hash of each repaired conversation. A hash runs over a conversation from its beginning to its end, so its rows
    pass through one task, sorted by Spark and read as a stream; nothing is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv = h = None
        for batch in batches:
            done = []
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if h is None or c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h, first = c, hashlib.sha256(), True
                if role is not None:
                    h.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            kinds = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kinds), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kinds), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    deleted = F.col("edit") == "D"
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return turns.select("conv_id", F.when(~deleted, F.col("role")).alias("role"), F.when(~deleted, F.col("text")).alias("text")).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def reports(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of `rows`.

    `audit` has one letter for each edit in order (K, R, D, I). The hash is that of `role:text` of the repaired rows,
    joined by newlines.
    """
    first = cut(_walk(_sorted(rows, conv_col, turn_col, role_col, text_col), costs, REPORT, _report))
    whole = first.where("NOT edge").select("conv_id", *_names(REPORT))
    kept, edits, states = _pieces(first.where("edge").select("conv_id", *_names(EDGE)), costs)
    parts = F.sort_array(F.collect_list(F.struct("part", "edits")))
    audit = edits.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit"))
    for other in (audit, _hashed(_stitched(kept, edits))):
        other = other.withColumnRenamed("conv_id", "c")
        states = states.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return whole.unionByName(states.select("conv_id", *_names(REPORT)))


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()) -> DataFrame:
    """All rows with their edit (K, R, D; D rows are not part of the repaired conversation) and the inserted ones (I):
    conv_id, part, place, edit, turn, role, text. Rows of a conversation are in order by part and place."""
    first = cut(_walk(_sorted(rows, conv_col, turn_col, role_col, text_col), costs, ROW, _turns))
    whole = first.where("NOT edge").select("conv_id", *_names(ROW))
    kept, edits, _ = _pieces(first.where("edge").select("conv_id", *_names(EDGE)), costs)
    return whole.unionByName(_stitched(kept, edits))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults put in by the CRC-32 of `conv_id:turn`: a twentieth each of the rows is
    dropped, emptied, stripped of sentence ends, repeated, or given to the user. Nulls count as one blank."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), what.alias("what"))
    text: Column = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
