"""Corpus search and corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from semcorpus.settings import DEFAULTS, Settings

# Helper functions travel inside the task closure, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "Settings"]
