"""Structured Streaming: hits delivered while files or rows arrive.

The search is the same lazy transformation as in batch (stateless: scan,
split, filter), so ``stream result == batch result``.  Running counts and the
newest-per-key history are streaming aggregates with state in the
checkpoint folder.  Trigger choices map the reference's incremental delivery:
bounded batches (``maxFilesPerTrigger`` / ``processingTime``), a final drain
(``availableNow``), progress (``StreamingQuery.lastProgress``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linesift.operators.grep import search_corpus
from linesift.operators.history import HISTORY_CAP
from linesift.session import shared_folder


def table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A growing Parquet table (new files appended to ``path``) as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def file_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New files under ``root`` as a stream of ``file_path, length, content``; the source reads contents only where they are used."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(root).select(F.col("path").alias("file_path"), "length", "content")


def decoded_files(files: DataFrame) -> DataFrame:
    """``file_path, content`` -> ``file_path, text, stage, message``: binary files left out, one row for each other file.

    A file that no candidate encoding decodes has no text but a message.  The decoding is row-local (native for UTF-8,
    Python codecs otherwise), so it runs on streams as well.
    """
    from linesift.operators.encoding import decode, is_binary

    readable = files.where(~is_binary("content")).select(F.col("file_path").alias("path"), "content")
    stage = F.when(F.col("error").isNotNull(), "decode")
    return decode(readable).select(F.col("path").alias("file_path"), "text", stage.alias("stage"), F.col("error").alias("message"))


def text_corpus(files: DataFrame) -> DataFrame:
    """``file_path, content`` -> ``file_path, text`` of the files that can be decoded (:func:`decoded_files` has the others too)."""
    return decoded_files(files).where(F.col("stage").isNull()).select("file_path", "text")


def scan_batches(files: DataFrame, needle: str, out_path: str, name: str, trigger: dict | None = None, **opts) -> StreamingQuery:
    """Every micro-batch of :func:`file_stream` through the full scan (Office packages included).

    The batch is a listing: its files are read once, by path, into one tagged table ``out_path_tagged/batch_id=<n>``; the
    hits (``out_path/batch_id=<n>``) and the errors (``out_path_errors/batch_id=<n>``), undecodable and unreadable files
    among them, are written from it.  All three are overwritten, so a retried batch replaces its own output.
    """
    from linesift.operators.grep import compile_search
    from linesift.operators.output import search_outcome, write_outcome
    from linesift.operators.prune import with_path_parts
    from linesift.plans.search import scan_parts

    search = compile_search(needle, **opts)

    def run(batch: DataFrame, batch_id: int) -> None:
        listing = with_path_parts(batch.select(F.col("file_path").alias("path"), "file_path", "length"))
        found = write_outcome(search_outcome(scan_parts(listing), search), f"{out_path}_tagged/batch_id={batch_id}", "overwrite")
        found.hits.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        found.errors.write.mode("overwrite").parquet(f"{out_path}_errors/batch_id={batch_id}")

    return start(files, name, trigger=trigger, foreach_batch=run)


def stream_hits(corpus: DataFrame, needle: str, **opts) -> DataFrame:
    """Stateless search over a streaming corpus (``file_path, text``)."""
    return search_corpus(corpus, needle, **opts)


def running_counts(hits: DataFrame, key: str = "file_path") -> DataFrame:
    """Hits per key so far (use output mode ``update`` or ``complete``)."""
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def newest_per_key(log: DataFrame, keys: list[str], order: list[str], payload: list[str] = ()) -> DataFrame:
    """Newest entry per key so far (streaming ``max_by``; state holds one row per key, ``streaming/recent.py`` a constant number)."""
    rank = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in dict.fromkeys(list(order) + list(payload))])
    return log.groupBy(*keys).agg(F.max_by(row, rank).alias("e")).select(*keys, "e.*")


def top_recent(batch: DataFrame, order: list[str], cap: int = HISTORY_CAP) -> DataFrame:
    """Top ``cap`` of a micro-batch result (used inside ``foreachBatch``)."""
    return batch.orderBy(*[F.col(c).desc() for c in order]).limit(cap)


def start(
    df: DataFrame,
    name: str,
    output_mode: str = "append",
    sink: str = "parquet",
    path: str | None = None,
    trigger: dict | None = None,
    foreach_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start a query; state and progress go to ``<spark.checkpoint.dir>/streams/<name>`` (see ``session.shared_folder``)."""
    root = shared_folder(df.sparkSession)
    writer = df.writeStream.queryName(name).outputMode(output_mode).option(
        "checkpointLocation", f"{root}/streams/{name}"
    )
    if trigger:
        writer = writer.trigger(**trigger)
    if foreach_batch is not None:
        return writer.foreachBatch(foreach_batch).start()
    writer = writer.format(sink)
    return writer.start(path) if path else writer.start()
