import public_tokenizers
import pytest
from llm_common import by_id
from tokenizers import Tokenizer

from semcorpus.llm import token_counts

ODD = [
    "", "a b", "<|endoftext|> x<|startoftext|>y", "a\x1cb c", "a\x85b\xa0c d　e é ÉΑΣ ΣΑΣ don't I'LL it's 123 ½²", "\x00 x\x1f",
    "日本 İstanbul ǅ", " ".join(map(chr, range(1, 3000))), "x" * 5000, "a ́b é ̃ ", "ﬁ Å ㎏",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, text):
    return len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)


def test_documents(documents, texts, library):
    found = by_id(token_counts.count_tokens(documents, token_counts.default_tokenizer()))
    assert {k: (v[0]["n_bytes"], v[0]["n_tokens"]) for k, v in found.items()} == {k: expected(library, t) for k, t in texts.items()}


@pytest.mark.parametrize("held", [1 << 17, 3])
def test_odd_texts_held_and_joined(spark, library, held):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    found = by_id(token_counts.count_tokens(df, token_counts.default_tokenizer(), held=held))
    assert [(found[i][0]["n_bytes"], found[i][0]["n_tokens"]) for i in range(len(ODD))] == [expected(library, t) for t in ODD]


def test_odd_rows(odd, none, library):
    found = by_id(token_counts.count_tokens(odd, token_counts.default_tokenizer(), held=2))
    for key, rows in found.items():
        text = odd.where(odd.doc_id.eqNullSafe(key)).first()["text"]
        assert all((r["n_bytes"], r["n_tokens"]) == expected(library, text) for r in rows)
    assert len(found[6]) == 2 and sum(map(len, found.values())) == 10
    assert token_counts.count_tokens(none, token_counts.default_tokenizer()).count() == 0


def test_each_run_is_counted_once(documents):
    runs = token_counts.distinct_runs(documents, "text", token_counts.default_tokenizer())
    assert runs.count() == runs.select("run").distinct().count()
