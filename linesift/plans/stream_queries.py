"""Queries whose work is done by a stream over a given table, drained to its end, with the SQL of the batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.plans import params as P
from linesift.plans.oracle import ORACLE_SQL as BATCH
from linesift.session import shared_folder
from linesift.sources.tables import documents_path
from linesift.streaming import grep_stream as gs
from linesift.streaming import recent

DRAIN = {"availableNow": True}


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    # A stream source takes a directory or a pattern; as a pattern the name also fits a table that is one file.
    root = f"{sf.rstrip('/')}/{table}"
    return gs.table_stream(spark, f"{root}[.]parquet", spark.read.parquet(f"{root}.parquet").schema)


def q_stream_hits(spark: SparkSession, sf: str) -> DataFrame:
    """X1: the hits of a literal search, delivered by a stream into a Parquet sink."""
    name = f"stream-hits-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}-out"
    corpus = _stream(spark, sf, "documents").select(documents_path().alias("file_path"), "text")
    hits = gs.stream_hits(corpus, P.NEEDLE).select("file_path", "line_number", "line_content")
    gs.start(hits, name, path=out, trigger=DRAIN).awaitTermination()
    return spark.read.schema(hits.schema).parquet(out)


def q_stream_recent(spark: SparkSession, sf: str) -> DataFrame:
    """X6: the newest distinct keys, kept by a stream with state of constant size."""
    name = f"stream-recent-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}-out"
    keys, order, payload = ["user_id", "event_type"], ["ts", "event_id"], ["value"]
    events = _stream(spark, sf, "events")
    recent.recent_batches(events, keys, order, out, name, payload, trigger=DRAIN).awaitTermination()
    top = recent.read_recent(spark, out, events, keys, order, payload)
    return top.select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_hits": q_stream_hits, "stream_recent": q_stream_recent}
ORACLE_SQL = {"stream_hits": BATCH["grep_literal"], "stream_recent": BATCH["history_recent"]}
