import base64
import random

import public_tokenizers
import pytest
import tiktoken
from llm_common import by_id

from semcorpus.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_round_trip(documents, texts, library):
    vocab = byte_bpe.default_vocabulary()
    found = by_id(byte_bpe.decode(byte_bpe.encode(documents, vocab), vocab))
    for key, text in texts.items():
        assert found[key][0]["ids"] == library.encode_ordinary(text) and bytes(found[key][0]["bytes"]) == text.encode()


def test_stitching_of_small_chunks(spark, library):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "1", "23", ".", "'s", "'ll", "é", "　", "!", "-", "\t", "日本", " a b ", "\U0001f600", "é", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 3, 50, 400, 1500]))) for _ in range(200)]
    texts += ["1" * 3000, "a" * 3000, " " * 3000, ("ab " * 50 + "7" * 500) * 4, "x y" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = by_id(byte_bpe.encode(df, byte_bpe.default_vocabulary(), chunk=40, overlap=8))
    assert [found[i][0]["ids"] for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_odd_rows(odd, none, library):
    vocab = byte_bpe.default_vocabulary()
    found = by_id(byte_bpe.decode(byte_bpe.encode(odd, vocab), vocab))
    assert found[1][0]["ids"] == [] and found[2][0]["ids"] == [] and bytes(found[1][0]["bytes"]) == b""
    assert len(found[6]) == 2 and found[6][0] == found[6][1] and found[7][0]["ids"] == found[6][0]["ids"]
    long = odd.where("doc_id = 5").first()["text"]
    assert found[5][0]["ids"] == library.encode_ordinary(long) and bytes(found[5][0]["bytes"]).decode() == long
    assert len(found[None]) == 1 and sum(map(len, found.values())) == 10
    assert byte_bpe.encode(none, vocab).count() == 0


def test_texts_without_blanks_are_chunked(library):
    """Japanese, code and lists of numbers."""
    for text in ("日本語の文章。" * 4000, "x=y(1);" * 4000, "12,34;" * 5000, "été\n" * 6000):
        parts = byte_bpe.cuts(text, 1000, 50)
        assert len(parts) >= len(text) // 1200 and all(b - a < 1200 for a, b in parts)
    assert len(byte_bpe.cuts("語" * 20_000, 1000, 50)) == 1


def test_chunks_of_texts_without_blanks(spark, library):
    texts = ["日本語の文章。" * 90, "x=y(1);'s" * 70, "12,34;" * 100, "été\n\n été's" * 60, "語" * 900, "1a2b3c " * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(byte_bpe.encode(df, byte_bpe.default_vocabulary(), chunk=60, overlap=10))
    assert [found[i][0]["ids"] for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_many_long_lists_in_one_batch(spark, monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "DECODED", 500)
    rows = [(i, library.encode_ordinary("some words here " * (i * 37 % 200))) for i in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    for r in byte_bpe.decode(df, byte_bpe.default_vocabulary()).collect():
        assert bytes(r["bytes"]).decode() == library.decode(r["ids"] or [])
