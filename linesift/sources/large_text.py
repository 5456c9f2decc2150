"""Large text files, split across tasks, with exact line numbers: a view of ``sources/ranges.py`` for UTF-8 files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.sources.ranges import ranged_texts, text_lines

SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def large_file_lines(spark: SparkSession, files: DataFrame, encodings=("utf-8",), range_bytes: int | None = None) -> DataFrame:
    """``path`` (URI), ``file_path``, ``length`` -> ``file_path, line_number, raw``, read by ranges of Spark's split size.

    Binary files (a NUL in the first 1,024 bytes) are skipped.
    """
    size = range_bytes or int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SPLIT_BYTES)))
    rows = files.select("path", "file_path", F.coalesce("length", F.lit(0)).alias("length"))
    return text_lines(ranged_texts(rows, list(encodings), size))


def large_file_segments(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Large files as ``segments`` (same schema as the in-row line scan)."""
    from linesift.plans.search import line_segments

    return line_segments(large_file_lines(spark, files))
