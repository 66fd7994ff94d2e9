"""Shared by the tests of this folder."""


def by_id(df, key="doc_id"):
    """Rows by id; several where an id repeats."""
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
