import base64

import public_tokenizers
import tiktoken
from test_decontaminate import expected as hits
from test_minhash_dedup import expected as groups

import corpus_pipeline
from semcorpus.llm import secret_scan
from semcorpus.llm.components import cut


def test_stages_against_plain_python(spark, documents, texts, sf):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    left, docs = dict(texts), documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, sf))
        rows = docs.collect()
        if name == "language_id":
            # Every text of the table is in one of its languages.
            assert {r["doc_id"] for r in rows} == {k for k, t in left.items() if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            left = {k: left[k] for k, (_, c) in groups(left, 80).items() if k == c}
        elif name == "decontamination":
            left = {k: left[k] for k, (_, n, _) in hits(left, items).items() if not n}
        elif name == "secret_scan":
            left = {k: secret_scan.hidden(t, "[REDACTED]") for k, t in left.items()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
            assert {r["doc_id"]: r["text"] for r in rows} == left
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: library.encode_ordinary(t) for k, t in left.items()}


def test_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
    # Nothing is known of any language, so every document is rejected.
    assert docs.count() == 0
    labelled = odd.drop("lang").selectExpr("*", "case when doc_id = 6 then 'en' end as lang")
    for _, stage in corpus_pipeline.STAGES:
        labelled = cut(stage(spark, labelled, sf))
    assert sorted(str(r["doc_id"]) for r in labelled.collect()) == ["4", "5", "6", "8", "None"]
