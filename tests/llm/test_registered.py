"""The registered queries themselves: beside their SQL, or beside the libraries."""

import base64
import hashlib

import compare
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from semcorpus.llm.queries import QUERIES

WITH_SQL = sorted(name for name, q in QUERIES.items() if q.sql)


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert {"op2_url_filter", "op5_embedding_dedup", "op6_minhash_dedup", "op10_decontaminate", "op11_conversation_repair", "op12_collocations"} <= set(WITH_SQL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_beside_sql(spark, sf, name):
    assert compare.compare(spark, compare.connect(sf), sf, QUERIES[name].run, QUERIES[name].sql) == ""


def test_byte_bpe(spark, sf, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for key, text in texts.items():
        ids = library.encode_ordinary(text or "")
        want[key] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))
    rows = QUERIES["op7_byte_bpe"].run(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want


def test_token_counts(spark, sf, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation(), library.no_padding()
    want = {}
    for key, text in texts.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[key] = (len((text or "").encode()), n, n > 2048)
    rows = QUERIES["op8_token_counts"].run(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == want


@pytest.mark.parametrize("name", ["op1_lm_scoring", "op3_toxicity", "op4_language_id"])
def test_a_row_for_each_document(spark, sf, texts, name):
    rows = QUERIES[name].run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
