"""Tokens per document, counted once per distinct pre-token.

A pre-token here is a longest run without white space: the tokenizer's normaliser and its pre-tokenizer never look
beyond one. The pieces of every distinct run of the corpus are counted once; documents carry only how often each run
occurs in them, and the two are joined. Runs found in many documents are looked up in a table of bounded size that
every task holds, as a join on them would meet in a few tasks; all others are joined. No ids are made per document.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcorpus.llm.batches import shared, slices, utf8
from semcorpus.llm.components import cut

# Runs in the table that every task holds: the most frequent ones.
HELD = 1 << 17
# Distinct runs that a task gathers before it passes their counts on.
GATHERED = 200_000
# White space as the tokenizer's patterns have it: unlike Python's without the separators U+001C to U+001F.
RUN = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class Counting:
    """A tokenizer, rebuilt in each process from its own JSON; its size is that of a vocabulary."""

    def __init__(self, definition: str):
        self.definition, self._ready = definition, None

    def __getstate__(self):
        return self.definition

    def __setstate__(self, state):
        self.__init__(state)

    def pieces(self, runs: list[str]) -> list[int]:
        if self._ready is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._ready = Tokenizer.from_str(self.definition)
            self._ready.no_truncation()
            self._ready.no_padding()
        return [len(e) for e in self._ready.encode_batch_fast(runs, add_special_tokens=False)]


def tokenizer(path: str) -> Counting:
    with open(path, encoding="utf-8") as f:
        return Counting(f.read())


def default_tokenizer(name: str = "word_bpe_49k.json") -> Counting:
    import public_tokenizers

    return tokenizer(public_tokenizers.path(name))


def run_lists(texts: pa.Array):
    """The runs of each text, one list after another."""
    raw, _ = utf8(texts)
    plain = not len(raw) or not ((raw >= 0x1C) & (raw <= 0x1F)).any()
    for text in texts.to_pylist():
        yield (text.split() if plain else RUN.findall(text)) if text else []


def _frequencies(batches):
    """How many documents hold each run, summed over as many documents as fit the bound."""
    seen: Counter = Counter()

    def passed():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["run", "docs"])

    for batch in batches:
        for lo, hi in slices(batch.column(0)):
            for runs in run_lists(batch.column(0).slice(lo, hi - lo)):
                seen.update(set(runs))
            if len(seen) > GATHERED:
                yield passed()
                seen.clear()
    if seen:
        yield passed()


def distinct_runs(docs: DataFrame, text_col: str, counting: Counting) -> DataFrame:
    """(run, docs, pieces): every distinct run of the table with its number of tokens, written to the shared folder."""
    sums = docs.select(text_col).mapInArrow(_frequencies, "run string, docs long").groupBy("run").agg(F.sum("docs").alias("docs"))
    sent = shared(docs.sparkSession, counting)

    def count(batches):
        for batch in batches:
            n = sent.value.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["run", "docs", "pieces"])

    return cut(sums.mapInArrow(count, "run string, docs long, pieces long"))


def count_tokens(docs: DataFrame, counting: Counting, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every document.

    Special strings inside a text count as the tokenizer's default has it: one token each. Null and empty texts have
    no bytes and no tokens. Every row has its own result, also where an id repeats or is null.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    known = distinct_runs(narrow, "text", counting)
    # Sixteen steps to each doubling; the table takes whole steps from the top, as many as it has room for.
    step = F.floor(F.log2("docs") * 16)
    least, room = 1 << 30, held
    for r in sorted(known.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = known.where(step >= least).select("run", "pieces").toArrow()
    table = dict(zip(top.column("run").to_pylist(), top.column("pieces").to_pylist()))
    sent = shared(docs.sparkSession, table)

    def rows(batches):
        """Per document a row with what the held table counts, and a row for each other run."""
        number, held_ = TaskContext.get().partitionId() << 40, sent.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                own, run, times, place = [], [], [], []
                for i, runs in enumerate(run_lists(texts)):
                    total = 0
                    for r, n in Counter(runs).items():
                        p = held_.get(r)
                        if p is None:
                            run.append(r)
                            times.append(n)
                            place.append(i)
                        else:
                            total += p * n
                    own.append(total)
                n = hi - lo
                ids = number + np.arange(n)
                number += n
                nothing = pa.nulls(len(run), batch.column(0).type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[place] if place else ids[:0]])),
                        pa.concat_arrays([batch.column(0).slice(lo, n), nothing]),
                        pa.concat_arrays([pa.array(np.diff(utf8(texts)[1])), pa.nulls(len(run), pa.int64())]),
                        # A blank and a number: no run, so the row meets nothing, and not all in one task.
                        pa.array([f" {i}" for i in ids.tolist()] + run, pa.string()),
                        pa.array([0] * n + times, pa.int64()),
                        pa.array(own + [0] * len(run), pa.int64()),
                    ],
                    names=["row", "doc_id", "n_bytes", "run", "times", "held"],
                )

    parts = narrow.mapInArrow(rows, f"row long, doc_id {kind}, n_bytes long, run string, times long, held long")
    rest = known.where(step < least).select("run", "pieces")
    joined = parts.join(rest, "run", "left")
    total = F.sum(F.col("held") + F.col("times") * F.coalesce("pieces", F.lit(0)))
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return sums.drop("row")
