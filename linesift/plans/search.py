"""End-to-end scan: files -> segments (+ errors) -> hits.

``scan`` splits the files by extension: Office packages go to the token job,
everything else (and Office files that gave no segments, read as text like the
reference does) goes through the binary test and the encoding job, then the
line scan.  Both branches give ``segments``; errors are a second output.

``scan_parts`` works on a listing (no bytes): it prunes, then reads only the survivors, each in one pass whose rows are
text, nothing (a binary file) or an error.  Text files of any size and candidate encoding take the same way
(``sources/ranges.py``).  Office packages are read in place, part by part.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.functions.text import basename, extension
from linesift.operators import encoding as enc
from linesift.operators import office
from linesift.operators.grep import grep
from linesift.operators.output import Outcome
from linesift.operators.plugins import normalized, plugin_outputs
from linesift.operators.prune import Exclusions, prune
from linesift.sources.files import load_contents, sized_for_loading
from linesift.sources.ranges import RANGE_BYTES, text_errors, text_files, text_lines
from linesift.sources.tables import empty_meta


def _has_ext(exts: Iterable[str]) -> Column:
    return extension(basename(F.col("file_path"))).isin(list(exts))


def merge_office_type(segments: DataFrame) -> DataFrame:
    """``{"office_type": ext, **metadata}``: parser keys win over the merged key."""
    meta = F.map_concat(
        F.create_map(F.lit("office_type"), F.col("ext")),
        F.col("metadata"),
    )
    return segments.withColumn(
        "metadata",
        F.when(F.map_contains_key("metadata", "office_type"), F.col("metadata")).otherwise(meta),
    )


def text_segments(files: DataFrame, encodings=enc.ENGINE_ENCODINGS) -> tuple[DataFrame, DataFrame]:
    """``file_path, content`` -> (line segments, decode errors); binary files are skipped silently."""
    readable = files.where(~enc.is_binary("content")).select(F.col("file_path").alias("path"), "content")
    decoded = enc.decode(readable, encodings)
    lines = enc.decoded_lines(decoded)
    segs = line_segments(lines.select(F.col("path").alias("file_path"), "line_number", "raw"))
    errs = decoded.where(F.col("error").isNotNull()).select(
        F.col("path").alias("file_path"), F.lit("decode").alias("stage"), F.col("error").alias("message")
    )
    return segs, errs


def scan(
    files: DataFrame | None = None,
    target_sheets: Iterable[str] | None = None,
    encodings=enc.ENGINE_ENCODINGS,
    office_files: DataFrame | None = None,
    text_files: DataFrame | None = None,
    parsers: dict | None = None,
    plugin_files: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``file_path, content`` -> (segments, errors).

    Pass ``files`` (split here by extension), or the branches already split
    (``office_files``, ``text_files``, ``plugin_files``) so each input is computed once.
    ``parsers`` (extension -> plug-in parser; the registered ones if ``None``) come before the
    built-in formats; a file whose parser gives nothing or fails is read as text.
    """
    parsers = normalized(parsers)
    if files is not None:
        plugin_files = files.where(_has_ext(parsers)) if parsers else None
        rest = files.where(~_has_ext(parsers)) if parsers else files
        office_files, text_files = rest.where(_has_ext(office.OFFICE_EXTS)), rest.where(~_has_ext(office.OFFICE_EXTS))
    tokens = office.tokenize(office_files.select(F.col("file_path").alias("path"), "content"), target_sheets)
    segs, errs = merge_office_type(office.office_segments(tokens, target_sheets)), office.errors(tokens)
    as_text = text_files.select("file_path", "content").unionByName(office.unreadable_packages(tokens))
    if plugin_files is not None:
        plugin_segs, plugin_errs, unparsed = plugin_outputs(plugin_files, parsers)
        segs, errs, as_text = segs.unionByName(merge_office_type(plugin_segs)), errs.unionByName(plugin_errs), as_text.unionByName(unparsed)
    txt, dec_errors = text_segments(as_text, encodings)
    return segs.unionByName(txt), errs.unionByName(dec_errors)


def line_segments(lines: DataFrame) -> DataFrame:
    """``file_path, line_number, raw`` as ``segments``."""
    return lines.select(
        "file_path",
        extension(basename(F.col("file_path"))).alias("ext"),
        F.col("line_number").cast("long").alias("seq"),
        "raw",
        "line_number",
        F.lit("").alias("location_display"),
        empty_meta().alias("metadata"),
    )


@dataclass(frozen=True)
class Parts:
    """What a listing gives: texts (``sources/ranges.py``), segments and errors of other formats, errors of listing."""

    files: DataFrame
    texts: DataFrame
    segments: DataFrame | None
    errors: DataFrame | None

    def all_segments(self) -> DataFrame:
        lines = line_segments(text_lines(self.texts))
        return lines if self.segments is None else self.segments.unionByName(lines)

    def all_errors(self) -> DataFrame:
        failed = text_errors(self.texts)
        return failed if self.errors is None else self.errors.unionByName(failed)


def scan_parts(listing: DataFrame, exclusions: Exclusions = Exclusions(), target_sheets=None,
               encodings=enc.ENGINE_ENCODINGS, range_bytes: int | None = RANGE_BYTES,
               parsers: dict | None = None, listing_errors: DataFrame | None = None,
               package_bytes: int = office.PACKAGE_BYTES) -> Parts:
    """A file listing (``list_tree``) -> its parts, pruning before any byte is read.

    ``range_bytes``: longer text files are dealt to tasks by ranges, packages longer than ``package_bytes`` by members;
    the result is the same for any values.
    """
    kept = prune(listing, exclusions)
    parsers = normalized(parsers)
    range_bytes = range_bytes or 1 << 62
    is_plugin = _has_ext(parsers) if parsers else F.lit(False)
    is_office = _has_ext(office.OFFICE_EXTS) & ~is_plugin
    long = F.col("length") > range_bytes
    branch = F.when(is_plugin, F.lit("plugin")).when(is_office, F.lit("office")).when(long, F.lit("long")).otherwise(F.lit("text"))
    # one aggregate over the listing sizes every branch
    stats = {
        r["branch"]: (int(r["b"] or 0), int(r["n"]))
        for r in kept.groupBy(branch.alias("branch")).agg(F.sum("length").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    }
    listed = kept.select("path", "file_path", "length")
    as_text, long_stats = listed.where(~is_plugin & ~is_office), stats.get("long", (0, 0))
    segs, errs = None, listing_errors
    join = lambda a, b: b if a is None else a.unionByName(b)
    if stats.get("office"):
        packages = sized_for_loading(listed.where(is_office), stats=stats["office"])
        tokens = office.tokenize_files(packages, target_sheets, package_bytes)
        broken = office.errors(tokens)
        # a package that could not be read to its end gives an error and nothing else
        unread = broken.where("stage = 'read'").select("file_path").distinct()
        segs = join(segs, merge_office_type(office.office_segments(tokens, target_sheets)).join(unread, "file_path", "left_anti"))
        errs = join(errs, broken)
        no_package = tokens.where(F.col("kind") == "raw").select(F.col("path").alias("file_path"))
        as_text = as_text.unionByName(listed.where(is_office).join(no_package, "file_path", "left_semi"))
        long_stats = None  # known when the packages have been looked at
    if stats.get("plugin"):
        loaded = load_contents(listed.where(is_plugin), stats=stats["plugin"])
        good, failed, unparsed = plugin_outputs(loaded.where(F.col("error").isNull()), parsers)
        segs, errs = join(segs, merge_office_type(good)), join(errs, failed)
        errs = join(errs, loaded.where(F.col("error").isNotNull()).select("file_path", F.lit("read").alias("stage"), F.col("error").alias("message")))
        as_text, long_stats = as_text.unionByName(listed.join(unparsed.select("file_path"), "file_path", "left_semi")), None
    if long_stats is None:
        # Files of other formats that are read as text after all can only be long if the listing has such long ones.
        longest = stats.get("long", (0, 0))[1] or kept.where(long & (is_office | is_plugin)).limit(1).count()
        long_stats = None if longest else (0, 0)
    texts = text_files(as_text, encodings, range_bytes, stats=stats.get("text", (0, 0)), long_stats=long_stats)
    return Parts(kept, texts, segs, errs)


def scan_listing(listing: DataFrame, exclusions: Exclusions = Exclusions(), target_sheets=None,
                 encodings=enc.ENGINE_ENCODINGS, large_file_bytes: int | None = RANGE_BYTES,
                 parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A file listing (``list_files``) -> (segments, errors), pruning before any byte is read.

    ``large_file_bytes`` is the range size of :func:`scan_parts`.
    """
    parts = scan_parts(listing, exclusions, target_sheets, encodings, large_file_bytes, parsers)
    return parts.all_segments(), parts.all_errors()


class SearchResult:
    """Outputs of a search over files: ``hits``, ``errors`` and a one-row ``summary``, each computed when it is used.

    :meth:`write` computes all of them in one pass over the files.
    """

    def __init__(self, parts: Parts, search):
        from linesift.operators.output import segments_summary

        self.parts, self.search = parts, search
        self.files, self.segments, self.errors = parts.files, parts.all_segments(), parts.all_errors()
        self.hits = grep(self.segments, search)
        # segments and hits in one aggregate: the summary reads the files once for both
        self.summary = segments_summary(self.files, self.segments, search, self.errors)

    def write(self, path: str, mode: str = "errorifexists") -> Outcome:
        """Write hits, errors and a row for each file (or range of one) to ``path``, from one reading of the files."""
        from linesift.operators.output import search_outcome, write_outcome

        return write_outcome(search_outcome(self.parts, self.search), path, mode)


def search_directory(
    spark,
    target_dir: str,
    search_text: str,
    regex_mode: bool = False,
    ignore_case: bool = False,
    whole_word: bool = False,
    exclude_dirs=None,
    exclude_exts=None,
    exclude_file_patterns=None,
    defaults: Exclusions = Exclusions(),
    target_sheets=None,
    parsers: dict | None = None,
    encodings=enc.ENGINE_ENCODINGS,
    range_bytes: int | None = RANGE_BYTES,
) -> SearchResult:
    """The reference's search call on a directory tree, as DataFrames.

    The pattern is compiled (and an invalid regex rejected) before anything is
    read; exclusion arguments replace ``defaults`` when given; only surviving
    files are read.
    """
    from linesift.operators.grep import compile_search
    from linesift.sources.files import list_tree

    s = compile_search(search_text, regex=regex_mode, ignore_case=ignore_case, whole_word=whole_word)
    ex = defaults.effective(exclude_dirs, exclude_exts, exclude_file_patterns)
    listing, unlisted = list_tree(spark, target_dir, exclude_dirs=ex.dirs)
    return SearchResult(scan_parts(listing, ex, target_sheets, encodings, range_bytes, parsers, unlisted), s)
