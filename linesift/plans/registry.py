"""All registered queries and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from linesift.plans import queries

    out = dict(queries.QUERIES)
    for mod_name in ("office_queries", "encoding_queries", "file_queries", "stream_queries"):
        mod = __import__(f"linesift.plans.{mod_name}", fromlist=["QUERIES"])
        out.update(mod.QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    from linesift.plans import oracle

    out = dict(oracle.ORACLE_SQL)
    for mod_name in ("office_queries", "encoding_queries", "file_queries", "stream_queries"):
        mod = __import__(f"linesift.plans.{mod_name}", fromlist=["ORACLE_SQL"])
        out.update(getattr(mod, "ORACLE_SQL", {}))
    known = all_queries()
    return {k: v for k, v in out.items() if k in known}
