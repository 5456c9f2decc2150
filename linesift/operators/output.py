"""Views and counts over hits: display rows, CLI lines, totals, per-file counts, -l/-L, first n.

A file is one input row, so all its lines live in one task: per-file counts are
finished by the partial aggregate before the shuffle, which then moves one row
per file, never the lines themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linesift.functions.text import basename, display_location, truncate_display


def display_rows(hits: DataFrame) -> DataFrame:
    """Result list view: ``file`` (basename), ``line`` (location or number), ``content``."""
    return hits.select(
        "file_path",
        basename("file_path").alias("file"),
        display_location("location_display", "line_number").alias("line"),
        F.col("line_content").alias("content"),
    )


def display_truncate(hits: DataFrame) -> DataFrame:
    """CLI view: ``path [location]`` or ``path:line``; content stripped and cut to 120 chars + ``...``."""
    where = F.when(
        F.col("location_display") != "",
        F.concat(F.col("file_path"), F.lit(" ["), F.col("location_display"), F.lit("]")),
    ).otherwise(F.concat(F.col("file_path"), F.lit(":"), F.col("line_number").cast("string")))
    return hits.select(where.alias("where"), truncate_display("line_content").alias("content"))


def hit_count(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("hits"))


def hits_per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_path").agg(F.count(F.lit(1)).alias("hits"))


def files_with_hits(files: DataFrame, hits: DataFrame) -> DataFrame:
    """``grep -l``: files with at least one hit (semi join against the distinct hit paths)."""
    return files.join(hits.select("file_path").distinct(), "file_path", "left_semi")


def files_without_hits(files: DataFrame, hits: DataFrame) -> DataFrame:
    """``grep -L``: files without any hit."""
    return files.join(hits.select("file_path").distinct(), "file_path", "left_anti")


def any_n_hits(hits: DataFrame, n: int) -> DataFrame:
    """Stop after ``n`` hits, whichever are found first: later partitions aren't read once there are enough."""
    return hits.limit(n)


def first_n_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits by (path, line, location), the same in every run; all files are read (``any_n_hits`` stops early)."""
    return hits.orderBy("file_path", "line_number", "location_display").limit(n)


def scan_summary(files: DataFrame, segments: DataFrame, hits: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, segments, hits, files with hits, errors.

    Each input is reduced to one partial row; the rows are unioned and folded by
    one global aggregate (no join between the inputs).
    """
    names = ["files", "segments", "hits", "files_with_hits", "errors"]

    def part(df: DataFrame, **aggs) -> DataFrame:
        cols = [aggs[n].alias(n) if n in aggs else F.lit(None).cast("long").alias(n) for n in names]
        return df.agg(*cols)

    one = F.count(F.lit(1))
    parts = [
        part(files, files=one),
        part(segments, segments=one),
        part(hits, hits=one, files_with_hits=F.countDistinct("file_path")),
    ]
    if errors is not None:
        parts.append(part(errors, errors=one))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def write_hits(hits: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Hit output as a table (Parquet); the rows stay distributed, nothing passes through the driver."""
    writer = hits.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def segments_summary(files: DataFrame, segments: DataFrame, search, errors: DataFrame | None = None) -> DataFrame:
    """``scan_summary`` with the hits counted in the same aggregate as the segments (one pass over them)."""
    hit = search.predicate(F.col("raw"))
    parts = [
        files.agg(F.count(F.lit(1)).alias("files")),
        segments.agg(
            F.count(F.lit(1)).alias("segments"),
            F.count_if(hit).alias("hits"),
            F.countDistinct(F.when(hit, F.col("file_path"))).alias("files_with_hits"),
        ),
    ]
    if errors is not None:
        parts.append(errors.agg(F.count(F.lit(1)).alias("errors")))
    names = ["files", "segments", "hits", "files_with_hits", "errors"]
    out = None
    for p in parts:
        row = p.select(*[F.col(n).cast("long") if n in p.columns else F.lit(None).cast("long").alias(n) for n in names])
        out = row if out is None else out.unionByName(row)
    return out.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def corpus_summary(corpus: DataFrame, search) -> DataFrame:
    """``scan_summary`` of a text corpus in one pass: per-file line and hit counts, then one global aggregate.

    A file is one row, so ``size(lines)`` and ``size(filter(lines, predicate))`` are row-local;
    nothing is exploded or shuffled before the final one-row aggregate.
    """
    from linesift.functions.text import line_pieces

    lines = line_pieces(F.col("text"))
    per_file = corpus.select(
        F.size(lines).alias("n"), F.size(F.filter(lines, lambda x: search.predicate(x))).alias("h")
    )
    return per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("segments"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("hits"),
        F.count_if(F.col("h") > 0).alias("files_with_hits"),
        F.lit(0).cast("long").alias("errors"),
    )


# ---------------------------------------------------------------- per-file results on a text corpus
# A file is one row: its line count, hit count and "has a hit" are computed inside
# the row (size / filter / exists over the line array).  No explode, join or shuffle.


def _line_array():
    from linesift.functions.text import line_pieces

    return line_pieces(F.col("text"))


def corpus_hits_per_file(corpus: DataFrame, search) -> DataFrame:
    """``file_path, hits`` for files with at least one hit."""
    from linesift.operators.grep import document_may_match

    pre = document_may_match(search)
    c = corpus.where(pre) if pre is not None else corpus
    counted = c.select("file_path", F.size(F.filter(_line_array(), lambda x: search.predicate(x))).alias("hits"))
    return counted.where(F.col("hits") > 0).withColumn("hits", F.col("hits").cast("long"))


def corpus_files_with_hits(corpus: DataFrame, search) -> DataFrame:
    """``grep -l`` on a text corpus: a row-local ``exists`` over the lines."""
    from linesift.operators.grep import document_may_match

    pre = document_may_match(search)
    c = corpus.where(pre) if pre is not None else corpus
    return c.where(F.exists(_line_array(), lambda x: search.predicate(x))).select("file_path")


def corpus_files_without_hits(corpus: DataFrame, search) -> DataFrame:
    """``grep -L`` on a text corpus: documents failing the pre-filter need no line test."""
    from linesift.operators.grep import document_may_match

    pre = document_may_match(search)
    no_line = ~F.exists(_line_array(), lambda x: search.predicate(x))
    cond = no_line if pre is None else (~pre | no_line)
    return corpus.where(cond).select("file_path")


# ---------------------------------------------------------------- everything a search finds, from one reading
OUTCOME = (
    "kind string, file_path string, line_content string, line_number int, location_display string, "
    "metadata map<string,string>, stage string, message string, segments long, hits long"
)


@dataclass(frozen=True)
class Outcome:
    """What a search wrote: the tagged table, its three views, and the counts that were observed while it was written."""

    table: DataFrame
    metrics: dict

    @property
    def hits(self) -> DataFrame:
        return self.table.where("kind = 'hit'").select("file_path", "line_content", "line_number", "location_display", "metadata")

    @property
    def errors(self) -> DataFrame:
        return self.table.where("stage is not null").select("file_path", "stage", "message")

    @property
    def per_file(self) -> DataFrame:
        """``file_path, segments, hits, skipped, failed`` of each file that was opened."""
        rows = self.table.where("kind <> 'hit'").groupBy("file_path")
        return rows.agg(F.sum("segments").alias("segments"), F.sum("hits").alias("hits"), F.bool_or(F.col("kind") == "skipped").alias("skipped"), F.bool_or(F.col("stage").isNotNull()).alias("failed"))


def _tagged(rows: DataFrame) -> DataFrame:
    """``rows`` with all columns of OUTCOME, null where they have none."""
    fields = [f.rsplit(" ", 1) for f in OUTCOME.replace("map<string,string>", "map").split(", ")]
    kinds = {n: "map<string,string>" if k == "map" else k for n, k in fields}
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def search_outcome(parts, search) -> DataFrame:
    """Hits, errors and files of a scan's parts as one table of tagged rows (OUTCOME).

    A text (a file or a range of one) gives its hits and one more row, inside the row it is: ``file``, ``skipped`` (binary)
    or ``error``.  So texts are read once, whatever is taken from the table.  Packages come from their staged tokens.
    """
    from linesift.functions.text import line_pieces, rstrip_py

    texts = parts.texts.withColumn("lines", F.coalesce(line_pieces(F.col("text")), F.array().cast("array<string>")))
    numbered = F.transform("lines", lambda x, i: F.struct((F.col("before") + i + 1).cast("int").alias("line_number"), x.alias("raw")))
    texts = texts.withColumn("found", F.filter(numbered, lambda x: search.predicate(x["raw"])))
    kind = F.when(F.col("stage").isNotNull(), "error").when(F.col("skipped"), "skipped").otherwise("file")
    one = F.struct(kind.alias("kind"), F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("string").alias("raw"))
    rows = F.concat(F.array(one), F.transform("found", lambda x: F.struct(F.lit("hit").alias("kind"), x["line_number"].alias("line_number"), x["raw"].alias("raw"))))
    texts = texts.select("file_path", "stage", "message", F.size("lines").alias("segments"), F.size("found").alias("hits"), F.explode(rows).alias("r"))
    own = F.col("r.kind") != "hit"
    only = lambda c: F.when(own, F.col(c)).alias(c)
    empty = F.when(~own, F.create_map().cast("map<string,string>"))
    out = _tagged(texts.select("file_path", "r.kind", rstrip_py(F.col("r.raw")).alias("line_content"), "r.line_number", F.when(~own, F.lit("")).alias("location_display"), empty.alias("metadata"), *map(only, ("stage", "message", "segments", "hits"))))
    if parts.segments is not None:
        from linesift.operators.grep import grep

        hit = search.predicate(F.col("raw"))
        per = parts.segments.groupBy("file_path").agg(F.count(F.lit(1)).alias("segments"), F.count_if(hit).alias("hits"))
        out = out.unionByName(_tagged(grep(parts.segments, search).withColumn("kind", F.lit("hit")))).unionByName(_tagged(per.withColumn("kind", F.lit("file"))))
    if parts.errors is not None:
        out = out.unionByName(_tagged(parts.errors.withColumn("kind", F.lit("error"))))
    return out


def write_outcome(outcome: DataFrame, path: str, mode: str = "errorifexists") -> Outcome:
    """Write the tagged rows, counting them on the way (``Dataset.observe``): no second job, no second reading."""
    seen = Observation()
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counted = outcome.observe(seen, of("hit").alias("hits"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), of("skipped").alias("skipped"), of("error").alias("errors"))
    counted.write.mode(mode).parquet(path)
    return Outcome(outcome.sparkSession.read.schema(OUTCOME).parquet(path), seen.get)
