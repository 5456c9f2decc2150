"""Recency-deduplicated history: newest entry per key (W2), capped to the newest ``n`` (T1).

The reference removes an equal entry and inserts the new one in front.  Over a
log of entries that is "newest per key", computed here with ``max_by`` in a
``groupBy``: a declarative aggregate with a partial (map-side) phase, so a key
holding a third of all rows is folded in every task before the shuffle and no
group is ever materialised.  The cap is a top-n (``TakeOrderedAndProject``):
each task keeps ``n`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY_CAP = 50  # fixed value: default number of entries kept


def newest_per_key(log: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the entry with the greatest ``order`` tuple (later columns break ties)."""
    rank = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in dict.fromkeys(order + payload)])
    return log.groupBy(*keys).agg(F.max_by(row, rank).alias("e")).select(*keys, "e.*")


def recent(log: DataFrame, keys: list[str], order: list[str], payload: list[str] = (), cap: int = HISTORY_CAP) -> DataFrame:
    """Newest ``cap`` distinct keys, newest first."""
    latest = newest_per_key(log, keys, list(order), list(payload))
    return latest.orderBy(*[F.col(c).desc() for c in order]).limit(cap)


def search_history(entries: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """History entries ``ts, keyword, directory, is_regex`` -> the list the reference keeps."""
    return recent(entries, ["keyword", "directory", "is_regex"], ["ts"], [], cap)


HISTORY_SCHEMA = "ts timestamp, keyword string, directory string, is_regex boolean"


def append_entry(spark, path: str, keyword: str, directory: str, is_regex: bool, ts=None) -> None:
    """Append one search to the history table at ``path`` (Parquet, append-only log)."""
    import datetime as dt

    when = ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(when, keyword, directory, bool(is_regex))], HISTORY_SCHEMA).write.mode("append").parquet(path)


def read_history(spark, path: str, cap: int = HISTORY_CAP) -> DataFrame:
    """The history as the reference shows it: newest first, one row per entry, at most ``cap``."""
    return search_history(spark.read.schema(HISTORY_SCHEMA).parquet(path), cap)
