"""Text, uri and keyword column functions. All are JVM built-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of letters or digits in any script.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The matched group, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def file_name(uri: Column | str) -> Column:
    return extract(uri, r"([^/]+)$")


def file_format(uri: Column | str) -> Column:
    return F.upper(extract(uri, r"\.([^.]+)$"))


def head(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def preview(text: Column | str, n: int = 200, mark: str = "...") -> Column:
    """The first n characters, marked when something was cut."""
    return F.when(F.length(col(text)) > n, F.concat(head(text, n), F.lit(mark))).otherwise(col(text))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(text)), TOKEN_BREAK), lambda t: t != "")


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), r"\s+"), lambda t: t != "")


def token_estimate(text: Column | str, whole: bool = False) -> Column:
    """A quarter of the characters; floored when whole."""
    n = F.length(col(text))
    return F.floor(n / 4) if whole else n / F.lit(4.0)


def query_terms(query: str) -> list[str]:
    return query.lower().split()


def keyword_hits(text: Column | str, terms: list[str]) -> Column:
    low = F.lower(col(text))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in terms])


def keyword_score(text: Column | str, terms: list[str]) -> Column:
    """Share of the terms found as literal substrings, ignoring case."""
    return keyword_hits(text, terms) / F.lit(float(len(terms)))


def keyword_match(text: Column | str, terms: list[str]) -> Column:
    low = F.lower(col(text))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def contains_ci(text: Column | str, needle: str) -> Column:
    return F.contains(F.lower(col(text)), F.lit(needle.lower()))


def to_text(data: Column | str) -> Column:
    """Bytes as a string, NULL when they are not valid UTF-8."""
    return F.try_validate_utf8(col(data).cast("string"))


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded for reports, with negative zero folded into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def row_sample(df: DataFrame, percent: int, id_col: str = "doc_id") -> DataFrame:
    """About percent of the rows, chosen by a hash of the id, so that every run and engine draws the same."""
    place = F.conv(F.substring(F.md5(F.col(id_col).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return df.where(place < percent)
