"""All registered queries."""

from semcorpus.plans import chunk_plans, index_plans, ingest_plans, media_plans, report_plans, search_plans  # noqa: F401
from semcorpus.plans.registry import QUERIES

__all__ = ["QUERIES"]
