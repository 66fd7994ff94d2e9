"""Search as SQL table functions over a registered corpus view.

Vectors passed to SQL are compared with lambdas, so these suit interactive use; jobs should call the
Python operators, which work on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from semcorpus.functions.vectors import hashing
from semcorpus.operators.search import query_vector
from semcorpus.settings import DEFAULTS, Settings

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def _cosine(a: str, b: str) -> str:
    dot, na, nb = (_DOT.format(a=x, b=y) for x, y in ((a, b), (a, a), (b, b)))
    return f"round(1 - {dot} / nullif(sqrt({na}) * sqrt({nb}), 0), 9) + 0D"


@F.udtf(returnType="query_id STRING, context STRING, texts INT, used_tokens DOUBLE")
class FillContext:
    """One context per partition of hits that come best first: headed texts while their tokens fit the budget.

    Hits of equal relevance count together: all of them fit, or none. At the first that do not, the rest of the partition is
    skipped. Missing texts weigh nothing and add nothing. A partition of which nothing fits gives no row.
    """

    def __init__(self):
        self.kept, self.equal = [], []
        self.used = self.pending = 0.0
        self.query = self.relevance = None

    def eval(self, hit: Row, max_tokens: float) -> None:
        if self.equal and hit["relevance_score"] != self.relevance:
            self._take()
        self.query, self.relevance = hit["query_id"], hit["relevance_score"]
        text = hit["text_content"]
        self.pending += len(text or "") / 4.0
        if self.used + self.pending > max_tokens:
            self.equal = []
            raise SkipRestOfInputTableException("the budget is used up")
        name = (hit["uri"] or "").rpartition("/")[2]
        whole = None not in (text, hit["source"]) and name
        self.equal.append(f"[Source: {hit['source']} - {name}]\n{text}\n---\n" if whole else None)

    def _take(self) -> None:
        self.kept += self.equal
        self.used += self.pending
        self.equal, self.pending = [], 0.0

    def terminate(self) -> Iterator[tuple]:
        if self.equal:
            self._take()
        if self.kept:
            yield self.query, "\n".join(t for t in self.kept if t is not None), len(self.kept), self.used


def register_sql(
    spark: SparkSession, corpus: DataFrame, view: str = "search_corpus", settings: Settings = DEFAULTS
) -> None:
    """Create the corpus view, cosine_distance, embed_query and the search functions.

    Functions that end in _text take the words of a query, the others its vector; both can stand after LATERAL with
    vectors of a table of queries. A LIMIT must be constant in SQL functions, so the rank is compared instead; Spark prunes to k rows per
    task before the rank is taken.
    """
    corpus.createOrReplaceTempView(view)
    vec = "ARRAY<DOUBLE>"
    rows = (
        "doc_id STRING, uri STRING, source STRING, modality STRING, text_content STRING, "
        "relevance_score DOUBLE, created_at TIMESTAMP, metadata STRING, distance DOUBLE"
    )
    names = "doc_id, uri, source, modality, text_content, relevance_score, created_at, metadata, distance"
    hit = (
        "doc_id STRING, uri STRING, modality STRING, source STRING, created_at TIMESTAMP, author STRING, "
        "channel STRING, distance DOUBLE, rel_score DOUBLE, text_content STRING"
    )
    hit_names = "doc_id, uri, modality, source, created_at, author, channel, distance, rel_score, text_content"
    pool = f"""SELECT *, row_number() OVER (ORDER BY distance, doc_id) AS rn FROM (
        SELECT *, cosine_distance(embedding, q) AS distance FROM {view} WHERE size(embedding) = size(q))
        WHERE distance IS NOT NULL"""
    floor, times = DEFAULTS.pool_floor, DEFAULTS.search_multiplier
    statements = [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a {vec}, b {vec}) RETURNS DOUBLE
        RETURN {_cosine("a", "b")}""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION semantic_search(q {vec}, k INT, threshold DOUBLE)
        RETURNS TABLE({rows}) RETURN
        SELECT doc_id, uri, source, modality, text_content, round(1 - distance, 3), created_at, meta, distance
        FROM ({pool}) WHERE rn <= coalesce(k, 10) AND 1 - distance >= coalesce(threshold, 0)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search(q {vec}) RETURNS TABLE({rows}) RETURN
        SELECT {names} FROM semantic_search(q, 10, 0D)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_by_source(q {vec}, sources ARRAY<STRING>, k INT)
        RETURNS TABLE({rows}) RETURN
        SELECT {names} FROM semantic_search(q, coalesce(k, 10), 0D) WHERE array_contains(sources, source)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_by_date(q {vec}, d1 DATE, d2 DATE, k INT)
        RETURNS TABLE({rows}) RETURN
        SELECT {names} FROM semantic_search(q, coalesce(k, 10), 0D) WHERE to_date(created_at) BETWEEN d1 AND d2""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_content(q {vec}, n INT)
        RETURNS TABLE(text_content STRING) RETURN
        SELECT text_content FROM semantic_search(q, coalesce(n, 5), 0D)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION semantic_grep_tf(
            q {vec}, k INT, sources ARRAY<STRING>, t1 TIMESTAMP, t2 TIMESTAMP, pattern STRING)
        RETURNS TABLE({hit}) RETURN
        SELECT {hit_names} FROM (
            SELECT *, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM (
                SELECT doc_id, uri, modality, source, created_at, author, channel, distance,
                       CAST(NULL AS DOUBLE) AS rel_score, text_content
                FROM ({pool}) WHERE rn <= greatest(k * {times}, {floor})
                AND (size(sources) = 0 OR array_contains(sources, source))
                AND created_at BETWEEN t1 AND t2
                AND (pattern IS NULL OR pattern = '' OR text_content RLIKE pattern)))
        WHERE rank <= k""",
    ]
    statements += [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION semantic_search_text(ask STRING, k INT, threshold DOUBLE)
        RETURNS TABLE({rows}) RETURN
        SELECT {names} FROM semantic_search(embed_query(ask), k, threshold)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_text(ask STRING) RETURNS TABLE({rows}) RETURN
        SELECT {names} FROM semantic_search(embed_query(ask), 10, 0D)""",
        # A function in SQL may not hand a table to a table function, so the budget is a running sum here.
        f"""CREATE OR REPLACE TEMPORARY FUNCTION get_rag_context(q {vec}, max_tokens DOUBLE)
        RETURNS TABLE(context STRING) RETURN
        SELECT array_join(transform(array_sort(collect_list(struct(rn, part))), s -> s.part), '\\n') FROM (
            SELECT row_number() OVER (ORDER BY relevance_score DESC, distance, doc_id) AS rn,
                   sum(length(text_content) / 4.0D) OVER (ORDER BY relevance_score DESC) AS used,
                   concat('[Source: ', source, ' - ', nullif(regexp_extract(uri, '([^/]+)$', 1), ''), ']\\n',
                          text_content, '\\n---\\n') AS part
            FROM semantic_search(q, 15, 0.7D)) WHERE used <= max_tokens HAVING count(*) > 0""",
    ]
    spark.udtf.register("fill_context", FillContext)
    spark.udf.register("embed_query", hashing(settings.dim))
    for s in statements:
        spark.sql(s)


def sql_vector(query: str | Sequence[float], settings: Settings = DEFAULTS) -> str:
    """A query as a SQL array literal."""
    return "array(" + ",".join(f"{float(x)!r}D" for x in query_vector(query, settings.dim)) + ")"


def create_search_view(
    corpus: DataFrame, query: str | Sequence[float], k: int = 20, name: str = "search_interface",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """A stored search as a temp view; it runs when it is read."""
    from semcorpus.operators.search import search

    found = search(corpus, query, k, candidates=k, settings=settings).selectExpr(
        "doc_id", "uri", "source", "modality", "created_at", "text_content", "distance AS similarity_score"
    )
    found.createOrReplaceTempView(name)
    return found
