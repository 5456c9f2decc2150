"""Mixed file trees: parser dispatch by extension, text fallback, error side output, file listing.

The tree is derived from ``documents``: ``en`` rows are plain text files,
``de`` rows Word, ``fr`` rows Excel and ``es`` rows PowerPoint packages; rows
of source ``src0`` in those three languages are broken packages (their text
bytes under the Office name), which the reference reports and then reads as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.operators.grep import compile_search, grep
from linesift.operators.output import search_outcome, write_outcome
from linesift.plans import office_queries as OQ
from linesift.plans.oracle import DOC_PATH, lines as sql_lines, rstrip as sql_rstrip
from linesift.plans.search import scan, scan_parts
from linesift.session import shared_folder
from linesift.sources.files import _open, list_files, list_tree
from linesift.sources.office_writer import pack
from linesift.sources.tables import documents_path, read_table

# Fixed for this tree: which language is stored in which format, and the broken source directory.
LANG_KIND = {"en": "text", "de": "docx", "fr": "xlsx", "es": "pptx"}
BROKEN_SOURCE = "src0"


def mixed_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(Office files, text files) of the tree; text bytes are encoded natively, packages in Python."""
    docs = read_table(spark, sf, "documents")
    kind = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in LANG_KIND.items() for x in (F.lit(k), F.lit(v))]),
                                       F.col("lang")), F.lit("text"))
    ext = F.when(kind == "text", F.lit(".txt")).otherwise(F.concat(F.lit("."), kind))
    broken = (kind != "text") & (F.col("source") == BROKEN_SOURCE)
    rows = docs.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext)).alias("path"),
        "text", "source", "lang", "n_chars",
        F.when(broken, F.lit("broken")).otherwise(kind).alias("kind"),
    )
    office_rows = rows.where(F.col("kind") != "text")
    text_files = rows.where(F.col("kind") == "text").select(
        F.col("path").alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    return pack(office_rows).select(F.col("path").alias("file_path"), "content"), text_files


def _scan_mixed(spark, sf):
    office_files, text_files = mixed_files(spark, sf)
    return scan(office_files=office_files, text_files=text_files)


def q_scan_mixed(spark, sf):
    segs, _errors = _scan_mixed(spark, sf)
    hits = grep(segs, "")
    return hits.select("file_path", "line_number", "location_display", "line_content",
                       F.col("metadata")["office_type"].alias("office_type"))


def q_office_text_fallback(spark, sf):
    segs, _errors = _scan_mixed(spark, sf)
    fb = segs.where((F.col("location_display") == "") & F.col("ext").isin(".docx", ".xlsx", ".pptx"))
    return grep(fb, "").select("file_path", "line_number", "line_content")


def q_scan_errors(spark, sf):
    _segs, errors = _scan_mixed(spark, sf)
    return errors.select("file_path", "stage", "message")


# Fixed for the written tree: which languages are stored as Latin-1 (where they can be), and how long a range is.
LATIN_LANGS = ("fr", "es")
TREE_ENCODINGS = ("utf-8", "latin-1")
TREE_RANGE_BYTES = 1500


def tree_files(spark, sf) -> DataFrame:
    """``documents`` as files: German with a BOM, French and Spanish in Latin-1 where that loses nothing, else UTF-8."""
    docs = read_table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    latin = F.col("lang").isin(*LATIN_LANGS) & ~F.col("text").rlike("[^\\x00-\\xff]")
    content = (
        F.when(latin, F.encode("text", "ISO-8859-1"))
        .when(F.col("lang") == "de", F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return docs.select(documents_path().alias("file_path"), content.alias("content"))


def written_tree(spark, sf) -> str:
    """The files of :func:`tree_files`, written by the tasks below the shared folder; a task that runs again writes the same."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                filesystem, place = _open(f"{root}/{name}")
                filesystem.create_dir(place.rsplit("/", 1)[0])
                with filesystem.open_output_stream(place) as f:
                    f.write(content.as_py())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    tree_files(spark, sf).mapInArrow(write, "n long").agg({"n": "sum"}).collect()
    return root


def q_files_list(spark, sf):
    """The listing of a tree written from ``documents``: no file is opened."""
    files = list_files(spark, written_tree(spark, sf))
    return files.select("file_path", "base_name", "ext", F.array_join("dirs", "/").alias("dirs"), "length")


def _tree_parts(spark, sf):
    listing, errors = list_tree(spark, written_tree(spark, sf))
    return scan_parts(listing, encodings=TREE_ENCODINGS, range_bytes=TREE_RANGE_BYTES, listing_errors=errors)


def q_range_scan(spark, sf):
    """All lines of a written tree of three encodings, read by byte ranges, with their numbers."""
    hits = grep(_tree_parts(spark, sf).all_segments(), "")
    return hits.select("file_path", "line_number", "line_content")


def q_range_encodings(spark, sf):
    """The encoding that each file of the tree was read in."""
    return _tree_parts(spark, sf).texts.where("encoding is not null").select("file_path", "encoding").distinct()


def q_search_outcome(spark, sf):
    """Lines and hits of each file of the tree, from the tagged table that one reading of the files wrote."""
    outcome = search_outcome(_tree_parts(spark, sf), compile_search("the"))
    return write_outcome(outcome, f"{shared_folder(spark)}/outcome-{uuid.uuid4().hex}").per_file


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}


def _mixed_path(ext_sql: str) -> str:
    return f"concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || {ext_sql})"


_KIND_EXT = "CASE lang WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.xlsx' WHEN 'es' THEN '.pptx' ELSE '.txt' END"
_OFFICE_LANGS = "('de', 'fr', 'es')"


def _text_lines(where: str) -> str:
    base = sql_lines("documents", where, path=_mixed_path(_KIND_EXT))
    return f"SELECT file_path, line_number, {sql_rstrip('raw')} AS line_content FROM {base}"


_FALLBACK = _text_lines(f"lang IN {_OFFICE_LANGS} AND source = '{BROKEN_SOURCE}'")


def _office_part(sql: str, lang: str, ext: str) -> str:
    return (
        f"SELECT file_path, CAST(0 AS INTEGER) AS line_number, location_display, line_content, '{ext}' AS office_type "
        f"FROM ({sql}) WHERE split_part(file_path, '/', 2) = '{lang}' AND split_part(file_path, '/', 1) <> '{BROKEN_SOURCE}'"
    )


SCAN_MIXED_SQL = " UNION ALL ".join(
    [
        "SELECT file_path, line_number, '' AS location_display, line_content, CAST(NULL AS VARCHAR) AS office_type "
        f"FROM ({_text_lines(f'lang NOT IN {_OFFICE_LANGS} OR source = ' + repr(BROKEN_SOURCE))})",
        _office_part(OQ.DOCX_SQL, "de", ".docx"),
        _office_part(OQ.XLSX_CELLS_SQL, "fr", ".xlsx"),
        _office_part(OQ.PPTX_SQL, "es", ".pptx"),
    ]
)

_TREE = "(SELECT *, coalesce(text, '') AS t FROM documents)"
_LATIN = "(lang IN ('fr', 'es') AND NOT regexp_matches(t, '[^\\x00-\\x{ff}]'))"

ORACLE_SQL = {
    "scan_mixed": SCAN_MIXED_SQL,
    "office_text_fallback": _FALLBACK,
    "scan_errors": (
        f"SELECT {_mixed_path(_KIND_EXT)} AS file_path, 'extract' AS stage, 'Error parsing ' || "
        "CASE lang WHEN 'de' THEN 'DOCX' WHEN 'fr' THEN 'XLSX' ELSE 'PPTX' END || ' ' || "
        f"{_mixed_path(_KIND_EXT)} || ': File is not a zip file' AS message "
        f"FROM documents WHERE lang IN {_OFFICE_LANGS} AND source = '{BROKEN_SOURCE}'"
    ),
    "files_list": (
        f"SELECT {DOC_PATH} AS file_path, CAST(doc_id AS VARCHAR) || '.txt' AS base_name, '.txt' AS ext, source || '/' || lang AS dirs, "
        f"CAST(CASE WHEN {_LATIN} THEN length(t) WHEN lang = 'de' THEN strlen(t) + 3 ELSE strlen(t) END AS BIGINT) AS length FROM {_TREE}"
    ),
    "range_scan": f"SELECT file_path, line_number, {sql_rstrip('raw')} AS line_content FROM {sql_lines('documents', 'true')}",
    "range_encodings": (
        f"SELECT {DOC_PATH} AS file_path, CASE WHEN lang = 'de' THEN 'utf-8-sig' "
        f"WHEN {_LATIN} AND regexp_matches(t, '[^\\x00-\\x7f]') THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM {_TREE}"
    ),
    "search_outcome": (
        "SELECT d.file_path, CAST(coalesce(l.n, 0) AS BIGINT) AS segments, CAST(coalesce(l.h, 0) AS BIGINT) AS hits, false AS skipped, false AS failed "
        f"FROM (SELECT {DOC_PATH} AS file_path FROM documents) d LEFT JOIN (SELECT file_path, count(*) AS n, count(*) FILTER (contains(raw, 'the')) AS h "
        f"FROM {sql_lines('documents', 'true')} GROUP BY file_path) l USING (file_path)"
    ),
}
