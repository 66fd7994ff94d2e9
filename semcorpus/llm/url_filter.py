"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL (a dot, the host, the path): `*` stands for any characters but a slash,
`**` for any at all, `?` for one. All states of all globs lie side by side in a row of 64-bit words. Each character
of a URL moves every glob at once: a shift, a mask of the states that the character leads to, and a mask of the
states that it may repeat. Batches of URLs move together, one character place at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import shared, utf8

# Rules of host and path with what they say.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Globs for URLs that no rule fits; what none of them fits is allowed.
BLOCKED = ("*.ads-track.**", "*.ads.**", "**/ads/**")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton(NamedTuple):
    start: np.ndarray  # first states
    step: np.ndarray  # by byte: states it leads to
    stay: np.ndarray  # by byte: states it repeats
    final: np.ndarray  # bit place of each glob's last state


def rule_glob(rule: str) -> str:
    """A rule of host and path fits the host, its subdomains, and all that follows."""
    return f"*.{rule}**"


def compile_globs(globs: list[str]) -> Automaton:
    """Masks over the states of all globs. A state stands for the glob's characters read so far."""
    starts, finals, steps, stays, at = [], [], [], [], 0
    for glob in globs:
        starts.append(at)
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                stays.append((at, np.arange(256)))
                i += 2
            elif raw[i : i + 1] == b"*":
                stays.append((at, np.setdiff1d(np.arange(256), [ord("/")])))
                i += 1
            else:
                at += 1
                steps.append((at, np.arange(256) if raw[i : i + 1] == b"?" else np.array([raw[i]])))
                i += 1
        finals.append(at)
        at += 1
    size = -(-at // 64)

    def bit(table: np.ndarray, places: list[tuple[int, np.ndarray]]):
        for state, bytes_ in places:
            table[bytes_, state // 64] |= np.uint64(1) << np.uint64(state % 64)

    step, stay, start = np.zeros((256, size), np.uint64), np.zeros((256, size), np.uint64), np.zeros((1, size), np.uint64)
    bit(step, steps)
    bit(stay, stays)
    bit(start, [(s, np.array([0])) for s in starts])
    return Automaton(start[0], step, stay, np.array(finals, np.int64))


def matches(auto: Automaton, urls: pa.Array) -> np.ndarray:
    """URL by glob: whether the whole URL fits."""
    raw, ends = utf8(urls)
    order = np.argsort(-np.diff(ends), kind="stable")
    begin, size = ends[:-1][order], np.diff(ends)[order]
    state = np.tile(auto.start, (len(order), 1))
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, side="left"))  # URLs longer than j
        c = raw[begin[:live] + j]
        now = state[:live]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:live] = (moved & auto.step[c]) | (now & auto.stay[c])
    out = np.zeros((len(order), len(auto.final)), bool)
    words, bits = auto.final // 64, (auto.final % 64).astype(np.uint64)
    out[order] = (state[:, words] >> bits) & np.uint64(1) == 1
    return out


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule and verdict of every URL.

    Of the rules that fit, the longest decides (then the longer host, then block). Without one the verdict is `block` where a
    glob of `blocked` fits, else `allow`. Null URLs and URLs without `://` have an empty host and path and fit nothing, so
    they are allowed. Every row has its own result.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[1] != "block"))
    auto = shared(pages.sparkSession, compile_globs([rule_glob(r) for r, _ in ranked] + list(blocked)))
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    known = len(ranked)

    def run(batches):
        for batch in batches:
            urls = pa.array(["." + h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.string())
            hit = matches(auto.value, urls)
            first = np.where(hit[:, :known].any(axis=1), hit[:, :known].argmax(axis=1), -1) if known else np.full(len(urls), -1)
            bad = hit[:, known:].any(axis=1)
            rule = [ranked[k][0] if k >= 0 else None for k in first.tolist()]
            verdict = [ranked[k][1] if k >= 0 else "block" if b else "allow" for k, b in zip(first.tolist(), bad.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict)], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
