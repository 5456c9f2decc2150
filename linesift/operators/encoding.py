"""Encoding job: BOM test, NUL (binary) test, encoding detection, decoding, script ratios.

Native first: the BOM and NUL tests, script-ratio counts and the decoding of
valid UTF-8 are built-in expressions, so most rows never leave the JVM.
Only bytes that are not valid UTF-8 go to a Python step (``mapInArrow``), which
tries each candidate codec (Spark's ``decode`` knows no CJK charsets) and only
counts; Spark puts the counts together and ranks the candidates in the row.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.functions.text import count_matching_chars, line_pieces

# Candidate encodings, in priority order.
ENGINE_ENCODINGS = ["utf-8", "cp932", "shift_jis", "euc_jp", "iso-2022-jp", "utf-16"]
OFFICE_ENCODINGS = [
    "utf-8-sig", "utf-8", "cp932", "shift_jis", "euc-jp", "iso-2022-jp",
    "gb18030", "gbk", "gb2312", "big5", "euc-kr", "cp949", "latin-1",
]
# Which encodings earn which script bonus (names as spelled by the reference).
JAPANESE_ENCODINGS = ["utf-8", "utf-8-sig", "cp932", "shift_jis", "euc-jp"]
CHINESE_ENCODINGS = ["gb18030", "gbk", "gb2312", "big5"]
KOREAN_ENCODINGS = ["euc-kr", "cp949"]
NUL_SPAN = 1024  # fixed value: bytes inspected for the binary test



# ---------------------------------------------------------------- native expressions
def is_binary(content: Column | str = "content") -> Column:
    """A NUL byte within the first 1,024 bytes (``contains`` on binary compares bytes, not characters)."""
    c = F.col(content) if isinstance(content, str) else content
    return F.contains(F.substring(c, 1, NUL_SPAN), F.lit(bytearray(b"\x00")))


def bom(content: Column | str = "content") -> Column:
    """``struct(encoding, confidence, detection_method, has_bom)`` from the leading bytes."""
    c = F.col(content) if isinstance(content, str) else content

    def head(n: int, value: bytes) -> Column:
        return F.substring(c, 1, n) == F.lit(bytearray(value))

    verdict = lambda enc, conf, how, has: F.struct(
        F.lit(enc).alias("encoding"), F.lit(conf).alias("confidence"),
        F.lit(how).alias("detection_method"), F.lit(has).alias("has_bom"),
    )
    return (
        F.when(head(3, b"\xef\xbb\xbf"), verdict("utf-8-sig", 1.0, "bom_detection", True))
        .when(head(2, b"\xff\xfe") | head(2, b"\xfe\xff"), verdict("utf-16", 0.9, "bom_detection", True))
        .when(head(4, b"\x00\x00\xfe\xff"), verdict("utf-32", 0.9, "bom_detection", True))
        .otherwise(verdict("utf-8", 0.0, "no_bom", False))
    )


def is_valid_utf8(content: Column | str = "content") -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.is_valid_utf8(c.cast("string"))


# Script ranges of the ratio heuristics, as (first, last code point, weight).
JAPANESE_RANGES = [(0x3040, 0x309F, 1.0), (0x30A0, 0x30FF, 1.0), (0x4E00, 0x9FAF, 1.0), (0xFF00, 0xFFEF, 0.5)]
CHINESE_RANGES = [(0x4E00, 0x9FAF, 1.0), (0xF900, 0xFAFF, 1.0)]
KOREAN_RANGES = [(0xAC00, 0xD7AF, 1.0), (0x1100, 0x11FF, 1.0)]


def _char_class(ranges, weight: float | None = None) -> str:
    """Regex class of the ranges (optionally only those of one weight), in ``\\x{..}`` form."""
    return "[" + "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi, w in ranges if weight is None or w == weight) + "]"


def script_counts(text: Column | str = "text") -> dict[str, Column]:
    """Integer counts behind the ratios: ``jp2`` (twice the Japanese weight: full-width forms count 1/2), ``zh``, ``ko``, ``n``."""
    t = F.col(text) if isinstance(text, str) else text
    jp_full = count_matching_chars(t, _char_class(JAPANESE_RANGES, 1.0))
    half = count_matching_chars(t, _char_class(JAPANESE_RANGES, 0.5))
    return {
        "jp2": 2 * jp_full + half,
        "zh": count_matching_chars(t, _char_class(CHINESE_RANGES)),
        "ko": count_matching_chars(t, _char_class(KOREAN_RANGES)),
        "n": F.length(t),
    }


def script_ratios(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``jp2, zh, ko, n`` and the ratios ``japanese, chinese, korean`` (0 for empty text)."""
    counts = script_counts(text)
    out = df.withColumns(counts)
    ratio = lambda num: F.when(F.col("n") > 0, num / F.col("n")).otherwise(F.lit(0.0))
    return out.withColumns(
        {"japanese": ratio(F.col("jp2") / F.lit(2.0)), "chinese": ratio(F.col("zh")), "korean": ratio(F.col("ko"))}
    )


# ---------------------------------------------------------------- the Python step (codecs)
_SCRIPTS = {"japanese": JAPANESE_RANGES, "chinese": CHINESE_RANGES, "korean": KOREAN_RANGES}
_BONUS = {**dict.fromkeys(JAPANESE_ENCODINGS, "japanese"), **dict.fromkeys(CHINESE_ENCODINGS, "chinese"),
          **dict.fromkeys(KOREAN_ENCODINGS, "korean")}
COUNT_CHARS = 1 << 20  # characters counted at a time
FACTS_TYPE = "array<struct<ord: int, encoding: string, n: bigint, script2: bigint, ascii: boolean, nfc: bigint, again: bigint>>"


def _script2(text: str, script: str | None) -> int:
    """Twice the weighted number of characters in the script's ranges (weights are 1 or 1/2)."""
    import numpy as np

    if script is None or text.isascii():
        return 0
    total = 0
    for i in range(0, len(text), COUNT_CHARS):
        points = np.frombuffer(text[i : i + COUNT_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        for lo, hi, weight in _SCRIPTS[script]:
            total += int(2 * weight) * int(np.count_nonzero((points >= lo) & (points <= hi)))
    return total


def _facts(content: bytes, encodings: Sequence[str]) -> list[dict]:
    """Counts of every candidate that decodes ``content``; ``again`` is the re-encoded length (null: can't be encoded)."""
    found = []
    for i, enc in enumerate(encodings):
        try:
            text = content.decode(enc)
        except (UnicodeError, LookupError):
            continue
        try:
            again = len(text.encode(enc))
        except UnicodeError:
            again = None
        found.append({"ord": i, "encoding": enc, "n": len(text), "script2": _script2(text, _BONUS.get(enc)),
                      "ascii": text.isascii(), "nfc": len(unicodedata.normalize("NFC", text)), "again": again})
    return found


def with_candidates(files: DataFrame, encodings: Sequence[str]) -> DataFrame:
    """``path, content`` -> the same with ``ranked``: ``confidence, ord, encoding`` of every candidate that decodes, best first.

    Python only counts; the confidence is put together in Spark, row by row, so no file bytes are shuffled.
    """
    import pyarrow as pa

    names = list(encodings)
    kinds = pa.list_(pa.struct([("ord", pa.int32()), ("encoding", pa.string()), ("n", pa.int64()), ("script2", pa.int64()),
                                ("ascii", pa.bool_()), ("nfc", pa.int64()), ("again", pa.int64())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            facts = [_facts(c.as_py(), names) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(facts, kinds)], names=["path", "content", "facts"])

    found = files.select("path", "content").mapInArrow(run, f"path string, content binary, facts {FACTS_TYPE}")
    return found.select("path", "content", ranked_candidates(F.col("facts"), F.length("content")).alias("ranked"))


def ranked_candidates(facts: Column, size: Column) -> Column:
    """``minus`` (the negated confidence), ``ord, encoding`` of the candidates counted in ``facts``, best first."""
    return F.array_sort(F.transform(facts, lambda x: F.struct(
        (-confidence(x, size)).alias("minus"), x["ord"].alias("ord"), x["encoding"].alias("encoding"))))


def confidence(x: Column, size: Column) -> Column:
    """Confidence of one strict decoding from its counts, between 0 and 1 (empty text: 0).

    Fixed values: the weights.  The replacement term counts the empty string, i.e. ``n + 1`` (D2).
    """
    n = x["n"]
    parts = (
        F.lit(-0.3) * (n + 1) / n,
        x["script2"] / (2 * n) * 0.4,
        F.when(x["ascii"], 0.1).otherwise(0.0),
        F.when(x["nfc"] == n, 0.2).otherwise(0.0),
        F.when(x["again"].isNull(), -0.1).when(x["again"] == size, 0.2).otherwise(0.0),
    )
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts[1:], parts[0])))).otherwise(0.0)


def _first_choice(sig: Column) -> Column:
    """UTF-8 with BOM, else the best candidate with a positive confidence, else UTF-8."""
    best = F.get("ranked", F.lit(0))
    return F.when(sig, F.lit("utf-8-sig")).when(best["minus"] < 0, best["encoding"]).otherwise(F.lit("utf-8"))


def chosen_encoding(sig: Column, valid: Column) -> Column:
    """Of column ``ranked``: the first choice where it decodes, else the first candidate that does; null if there is none.

    ``sig``: the content starts with the UTF-8 BOM; ``valid``: it is valid UTF-8.
    """
    decodes = F.exists("ranked", lambda x: x["encoding"] == _first_choice(sig)) | (sig & valid)
    in_order = F.array_sort(F.transform("ranked", lambda x: F.struct(x["ord"], x["encoding"])))
    return F.when(decodes, _first_choice(sig)).otherwise(F.get(in_order, F.lit(0))["encoding"])


def _known(encoding: str) -> bool:
    try:
        return codecs.lookup(encoding) is not None
    except LookupError:
        return False


def _decode_as(files: DataFrame, handler: Column, note: Column) -> DataFrame:
    """``path, content, encoding`` (null: no text) -> ``path, encoding, note, text``, by each row's codec error handler."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            path, content, encoding, handlers, notes = batch.columns
            text = [None if e is None else c.as_py().decode(e, h)
                    for c, e, h in zip(content, encoding.to_pylist(), handlers.to_pylist())]
            yield pa.RecordBatch.from_arrays([path, encoding, notes, pa.array(text, pa.string())],
                                             names=["path", "encoding", "note", "text"])

    rows = files.select("path", "content", "encoding", handler.alias("handler"), note.cast("string").alias("note"))
    return rows.mapInArrow(run, "path string, encoding string, note string, text string")


# ---------------------------------------------------------------- the job
def detect(files: DataFrame, encodings: Sequence[str] = ENGINE_ENCODINGS, prefer_utf8: bool = True) -> DataFrame:
    """``path, content`` -> ``path, encoding, confidence, detection_method, has_bom``.

    A BOM with confidence above 0.9 decides at once.  With ``prefer_utf8`` valid
    UTF-8 is taken natively; for everything else the candidates are counted in Python
    and ranked in the row (first candidate wins ties; no positive confidence ->
    ``utf-8``/``fallback``).  Empty content -> ``utf-8``/``empty_content``.
    """
    enc_list = list(encodings)
    f = files.select("path", "content").withColumn("bom", bom("content"))
    empty = F.length("content") == 0
    by_bom = F.col("bom.confidence") > 0.9
    native = empty | by_bom
    if prefer_utf8:
        native = native | is_valid_utf8("content")
    decided = f.where(native).select(
        "path",
        F.when(empty, F.lit("utf-8")).when(by_bom, F.col("bom.encoding")).otherwise(F.lit("utf-8")).alias("encoding"),
        F.when(empty, F.lit(0.0)).when(by_bom, F.col("bom.confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(empty, F.lit("empty_content")).when(by_bom, F.lit("bom_detection")).otherwise(F.lit("utf8_valid")).alias(
            "detection_method"
        ),
        F.col("bom.has_bom").alias("has_bom"),
    )
    best = F.get("ranked", F.lit(0))
    found = best["minus"] < 0
    scored = with_candidates(f.where(~native), enc_list).select(
        "path",
        F.when(found, best["encoding"]).otherwise(F.lit("utf-8")).alias("encoding"),
        F.when(found, -best["minus"]).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(found, F.lit("pattern_analysis")).otherwise(F.lit("fallback")).alias("detection_method"),
        bom("content")["has_bom"].alias("has_bom"),
    )
    return decided.unionByName(scored)


def decode(files: DataFrame, encodings: Sequence[str] = ENGINE_ENCODINGS, prefer_utf8: bool = True) -> DataFrame:
    """``path, content`` (non-binary) -> ``path, encoding, text, error``: one encoding per file, row-local.

    Valid UTF-8 (with or without BOM) is decoded natively.  Other files are
    ranked, then decoded (the detected encoding first, then the other
    candidates in order); a file no candidate decodes gives an
    ``error`` row.  No join: file bytes are never shuffled.  With
    ``prefer_utf8=False`` every file without a UTF-8 BOM goes through the scoring.
    """
    enc_list = list(encodings)
    f = files.select("path", "content")
    sig = F.substring("content", 1, 3) == F.lit(bytearray(b"\xef\xbb\xbf"))
    valid = is_valid_utf8("content")
    native_ok = (valid & (sig | F.lit(prefer_utf8))) | (F.length("content") == 0)
    text = F.when(sig, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    native = f.where(native_ok).select(
        "path",
        F.when(sig, F.lit("utf-8-sig")).otherwise(F.lit("utf-8")).alias("encoding"),
        text.alias("text"),
        F.lit(None).cast("string").alias("error"),
    )
    ranked = with_candidates(f.where(~native_ok), enc_list)
    chosen = chosen_encoding(sig, valid)
    note = F.when(chosen.isNull(), F.lit("no candidate encoding decodes the file"))
    other = _decode_as(ranked.withColumn("encoding", chosen), F.lit("strict"), note)
    other = other.select("path", "encoding", "text", F.col("note").alias("error"))
    return native.unionByName(other)


NOT_VALID = "not valid in its likeliest encoding; the next candidate was used with replacement characters"
NO_OTHER = "not valid in its likeliest encoding, and there is no other; UTF-8 was used with replacement characters"


def decode_lenient(files: DataFrame, encodings: Sequence[str] = OFFICE_ENCODINGS) -> DataFrame:
    """``path, content`` -> decoded content that never fails (``DecodedContent`` fields); valid UTF-8 stays native."""
    enc_list = list(encodings)
    valid = is_valid_utf8("content")
    sig = F.substring("content", 1, 3) == F.lit(bytearray(b"\xef\xbb\xbf"))
    native = files.where(valid).select(
        "path",
        F.when(sig, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string").alias("text"),
        F.when(sig, F.lit("utf-8-sig")).otherwise(F.lit("utf-8")).alias("encoding_used"),
        F.lit(True).alias("success"),
        F.lit(False).alias("has_replacement_chars"),
        F.array().cast("array<string>").alias("errors"),
    )
    native = native.withColumn("has_replacement_chars", F.col("text").contains("\ufffd"))
    # the first choice where it decodes, else the next candidate that Python knows, with replacement characters
    ranked = with_candidates(files.where(~valid), enc_list).withColumn("first", _first_choice(sig))
    strict = F.exists("ranked", lambda x: x["encoding"] == F.col("first"))
    spare = F.filter(F.array(*[F.lit(e) for e in enc_list if _known(e)]).cast("array<string>"), lambda e: e != F.col("first"))
    ranked = ranked.withColumn("strict", strict).withColumn("spare", F.get(spare, F.lit(0)))
    chosen = F.when(F.col("strict"), F.col("first")).otherwise(F.coalesce("spare", F.lit("utf-8")))
    note = F.when(~F.col("strict"), F.when(F.col("spare").isNull(), F.lit(NO_OTHER)).otherwise(F.lit(NOT_VALID)))
    handler = F.when(F.col("strict"), F.lit("strict")).otherwise(F.lit("replace"))
    other = _decode_as(ranked.withColumn("encoding", chosen), handler, note).select(
        "path", "text", F.col("encoding").alias("encoding_used"),
        (~F.col("note").eqNullSafe(F.lit(NO_OTHER))).alias("success"),
        (F.col("note").isNotNull() | F.col("text").contains("\ufffd")).alias("has_replacement_chars"),
        F.array_compact(F.array("note")).alias("errors"),
    )
    return native.unionByName(other)


def decoded_lines(decoded: DataFrame) -> DataFrame:
    """Decoded files -> ``path, line_number, raw`` (universal newlines, terminator kept)."""
    ok = decoded.where(F.col("error").isNull())
    return ok.select("path", "encoding", F.posexplode(line_pieces(F.col("text"))).alias("pos", "raw")).select(
        "path", "encoding", (F.col("pos") + 1).cast("int").alias("line_number"), "raw"
    )
