"""linesift: line-oriented corpus search as lazy Spark DataFrame transformations.

A corpus is any DataFrame with a path and text (or bytes).  Sources turn tables,
files and Office packages into a ``segments`` frame; operators filter, project
and count it; every result is a DataFrame, so the same code serves batch jobs
and Structured Streaming.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python steps (mapInArrow) pickle this package's functions by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from linesift.operators.grep import grep, compile_search  # noqa: E402
from linesift.sources.tables import corpus_segments, documents_corpus  # noqa: E402

from linesift.plans.search import scan, scan_listing, search_directory  # noqa: E402

__all__ = ["grep", "compile_search", "corpus_segments", "documents_corpus", "scan", "scan_listing", "search_directory"]
