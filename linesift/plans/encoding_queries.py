"""Encoding job queries over bytes Spark derives from ``documents``.

Each language is stored in another form: ``en`` UTF-8, ``de`` UTF-8 with BOM,
``fr`` ISO-8859-1, ``es`` UTF-16LE with BOM (which holds NUL bytes, so the
binary test skips it).  The queries that detect and decode use the forms of
``file_queries.tree_files``, which lose nothing and hold no NUL byte, so that
every row is detected and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.operators import encoding as enc
from linesift.plans.file_queries import TREE_ENCODINGS, tree_files
from linesift.plans.oracle import DOC_PATH, lines
from linesift.sources.tables import documents_path, read_table


def encoded_files(spark, sf) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    text = F.col("text")
    content = (
        F.when(F.col("lang") == "de", F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(text, "UTF-8")))
        .when(F.col("lang") == "fr", F.encode(text, "ISO-8859-1"))
        .when(F.col("lang") == "es", F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(text, "UTF-16LE")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return docs.select(documents_path().alias("path"), content.alias("content"), "lang")


def q_detect_bom(spark, sf):
    files = encoded_files(spark, sf)
    return files.select("path", enc.bom("content").alias("b")).select("path", "b.*")


def q_binary_skip(spark, sf):
    return encoded_files(spark, sf).where(~enc.is_binary("content")).select("path")


def q_script_ratio(spark, sf):
    docs = read_table(spark, sf, "documents").select(documents_path().alias("path"), "text")
    return enc.script_ratios(docs).select("path", "jp2", "zh", "ko", "n", "japanese", "chinese", "korean")


def readable_files(spark, sf) -> DataFrame:
    return tree_files(spark, sf).withColumnRenamed("file_path", "path").where(~enc.is_binary("content"))


def q_detect_encoding(spark, sf):
    return enc.detect(readable_files(spark, sf), TREE_ENCODINGS).select("path", "encoding", "detection_method", "has_bom")


def q_best_encoding(spark, sf):
    """The detection by scoring alone: all candidates of every file, the best by confidence, then by their order."""
    return enc.detect(readable_files(spark, sf), TREE_ENCODINGS, prefer_utf8=False).select("path", "encoding", "confidence", "detection_method")


def q_decode_lines(spark, sf):
    return enc.decoded_lines(enc.decode(readable_files(spark, sf), TREE_ENCODINGS))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

def _cnt(char_class: str) -> str:
    """Characters of ``text`` inside a class, counted as in Spark (length minus the length without them)."""
    return f"(length(text) - length(regexp_replace(text, '{char_class}', '', 'g')))"


# The ranges of the script ratios, written out here, so that the oracle stands by itself.
_JP_FULL = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]"
_JP_HALF = r"[\x{FF00}-\x{FFEF}]"
_ZH = r"[\x{4E00}-\x{9FAF}\x{F900}-\x{FAFF}]"
_KO = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"

_RATIO = (
    "SELECT path, jp2, zh, ko, n, CASE WHEN n > 0 THEN (jp2 / 2.0) / n ELSE 0.0 END AS japanese, "
    "CASE WHEN n > 0 THEN zh / n ELSE 0.0 END AS chinese, CASE WHEN n > 0 THEN ko / n ELSE 0.0 END AS korean FROM ("
    f"SELECT {DOC_PATH} AS path, CAST(2 * {_cnt(_JP_FULL)} + {_cnt(_JP_HALF)} AS INTEGER) AS jp2, "
    f"CAST({_cnt(_ZH)} AS INTEGER) AS zh, "
    f"CAST({_cnt(_KO)} AS INTEGER) AS ko, CAST(length(text) AS INTEGER) AS n "
    "FROM documents)"
)

# How each document is stored: Latin-1 or not, ASCII or not, and the size in bytes without a BOM.
_STORED = (
    "(SELECT *, CASE WHEN latin THEN length(t) ELSE strlen(t) END AS size FROM (SELECT *, "
    "lang IN ('fr', 'es') AND NOT regexp_matches(t, '[^\\x00-\\x{ff}]') AS latin, NOT regexp_matches(t, '[^\\x00-\\x7f]') AS ascii "
    "FROM (SELECT *, coalesce(text, '') AS t FROM documents)))"
)
_PLAIN = "CASE WHEN lang = 'de' THEN 'utf-8-sig' WHEN latin AND NOT ascii THEN 'latin-1' ELSE 'utf-8' END"
_METHOD = "CASE WHEN lang = 'de' THEN 'bom_detection' WHEN size = 0 THEN 'empty_content' WHEN latin AND NOT ascii THEN {scored} ELSE {valid} END"


def _confidence(n: str, script2: str, nfc: str) -> str:
    """The stated terms, added from left to right in doubles."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    total = f"{d(-0.3)} * ({n} + 1) / {n} + {d(script2)} / (2 * {n}) * {d(0.4)} + CASE WHEN ascii THEN {d(0.1)} ELSE {d(0)} END + CASE WHEN {nfc} THEN {d(0.2)} ELSE {d(0)} END + {d(0.2)}"
    return f"CASE WHEN {n} > 0 THEN greatest({d(0)}, least({d(1)}, {total})) ELSE {d(0)} END"


_UTF8 = f"CASE WHEN latin AND NOT ascii THEN -1 ELSE {_confidence('length(t)', '(2 * ' + _cnt(_JP_FULL).replace('text', 't') + ' + ' + _cnt(_JP_HALF).replace('text', 't') + ')', 'length(nfc_normalize(t)) = length(t)')} END"
_LATIN1 = _confidence("size", "0", "NOT latin OR length(nfc_normalize(t)) = length(t)")

ORACLE_SQL = {
    "detect_encoding": (
        f"SELECT {DOC_PATH} AS path, {_PLAIN} AS encoding, " + _METHOD.format(scored="CASE WHEN l > 0 THEN 'pattern_analysis' ELSE 'fallback' END", valid="'utf8_valid'")
        + f" AS detection_method, lang = 'de' AS has_bom FROM (SELECT *, {_LATIN1} AS l FROM {_STORED})"
    ),
    "best_encoding": (
        f"SELECT {DOC_PATH} AS path, CASE WHEN lang = 'de' THEN 'utf-8-sig' WHEN size = 0 OR greatest(u, l) <= 0 OR u >= l THEN 'utf-8' ELSE 'latin-1' END AS encoding, "
        "CASE WHEN lang = 'de' THEN CAST(1 AS DOUBLE) WHEN size = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(u, l, 0) END AS confidence, "
        "CASE WHEN lang = 'de' THEN 'bom_detection' WHEN size = 0 THEN 'empty_content' WHEN greatest(u, l) > 0 THEN 'pattern_analysis' ELSE 'fallback' END AS detection_method "
        f"FROM (SELECT *, {_UTF8} AS u, {_LATIN1} AS l FROM {_STORED})"
    ),
    "decode_lines": f"SELECT file_path AS path, {_PLAIN} AS encoding, line_number, raw FROM {lines('documents', 'TRUE', extra=('lang', 'latin', 'ascii'), table=_STORED)}",
    "detect_bom": (
        f"SELECT {DOC_PATH} AS path, CASE lang WHEN 'de' THEN 'utf-8-sig' WHEN 'es' THEN 'utf-16' ELSE 'utf-8' END AS encoding, "
        "CAST(CASE lang WHEN 'de' THEN 1.0 WHEN 'es' THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence, "
        "CASE WHEN lang IN ('de', 'es') THEN 'bom_detection' ELSE 'no_bom' END AS detection_method, "
        "lang IN ('de', 'es') AS has_bom FROM documents"
    ),
    "binary_skip": f"SELECT {DOC_PATH} AS path FROM documents WHERE lang <> 'es'",
    "script_ratio": _RATIO,
}
