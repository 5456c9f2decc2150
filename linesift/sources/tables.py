"""Tables as corpora (documents, pages, conversations, benchmark) and the line scan.

A corpus frame has one row per file: ``file_path string, text string``.  The
line scan explodes it into ``segments`` (one row per line, terminator kept),
a narrow transformation: no shuffle, one document's lines stay in its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.functions.text import basename, extension, line_pieces
from linesift.session import balanced

TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")



def empty_meta() -> Column:
    return F.create_map().cast("map<string,string>")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A given table; spread over the task slots when its scan has fewer partitions (see ``balanced``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(df) if spread else df


def documents_path() -> Column:
    """``source/lang/doc_id.txt``: ``source`` acts as the top directory."""
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def url_path() -> Column:
    """A page's URL as a path: host and path, without scheme, query or fragment."""
    return F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)", 1)


def documents_corpus(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(documents_path().alias("file_path"), F.col("text"), *extra)


def pages_corpus(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(url_path().alias("file_path"), F.col("html").alias("text"), *extra)


def conversations_corpus(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One file per turn: ``conv_id/turn.txt``."""
    conv = read_table(spark, sf_dir, "conversations")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".txt")))
    return conv.select(path.alias("file_path"), F.col("text"), *extra)


def benchmark_corpus(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark")
    return bench.select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text"), *extra)


CORPORA = {
    "documents": documents_corpus,
    "pages": pages_corpus,
    "conversations": conversations_corpus,
    "benchmark": benchmark_corpus,
}


def corpus_segments(corpus: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text corpus -> ``segments``: ``file_path, ext, seq, raw, line_number, location_display, metadata``.

    ``raw`` keeps the line terminator (normalised to ``\\n``); ``line_number`` is 1-based.
    """
    exploded = corpus.select(
        "file_path", *keep, F.posexplode(line_pieces(F.col("text"))).alias("pos", "raw")
    )
    return exploded.select(
        "file_path",
        extension(basename(F.col("file_path"))).alias("ext"),
        (F.col("pos") + 1).cast("long").alias("seq"),
        "raw",
        (F.col("pos") + 1).cast("int").alias("line_number"),
        F.lit("").alias("location_display"),
        empty_meta().alias("metadata"),
        *keep,
    )


def documents_tree(spark: SparkSession, sf_dir: str, names: dict[str, tuple[str, str]], *extra: str) -> DataFrame:
    """``documents`` as a file tree whose base names depend on the source directory.

    ``names`` maps a source to ``(prefix, suffix)`` around the doc_id; the lookup
    is a literal map inside the projection (no join).
    """
    docs = read_table(spark, sf_dir, "documents")
    pre = F.create_map(*[x for k, (p, _s) in names.items() for x in (F.lit(k), F.lit(p))])
    suf = F.create_map(*[x for k, (_p, s) in names.items() for x in (F.lit(k), F.lit(s))])
    base = F.concat(
        F.coalesce(F.try_element_at(pre, F.col("source")), F.lit("")),
        F.col("doc_id").cast("string"),
        F.coalesce(F.try_element_at(suf, F.col("source")), F.lit(".txt")),
    )
    path = F.concat_ws("/", F.col("source"), F.col("lang"), base)
    return docs.select(path.alias("file_path"), F.col("text"), *extra)
