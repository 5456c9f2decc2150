"""Text files of any size, read by byte ranges, with exact encodings and line numbers.

A file of at most ``range_bytes`` is read by one task in one pass, which decodes it or counts its candidate encodings.
A longer one is a row for each range of bytes:

1. Every range is read and counted under each candidate encoding.  It is cut where no encoding could be hurt: behind line
   ends, or for UTF-16 in front of a character that no normal form joins to the one before.  So the counts of a file's
   ranges add up to those of the file, and one verdict is drawn from them, as for a short file.  ISO-2022-JP is counted
   once for each character set that a range may begin in; the escapes of the ranges before tell which one holds.
2. A running sum over the ranges' lines in the chosen encoding gives the number of lines before each range.
3. Every range is read again and decoded: it owns the lines that begin in it, and the last one may end behind it.

Nothing but a row for each range is ever shuffled, and ranges of one file are read by many tasks.  A file that can't be
read, whole or in one of its ranges, gives an error row and no text.

Defined results: a file with a NUL byte among its first 1,024 is skipped; an empty one has no lines; a file that is shorter
than its listed length, or one with a line longer than a row may be (``LINE_BYTES``), gives an error row; where a candidate
encoding has no known line ends in its bytes, files are not cut.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesift.functions.text import line_pieces
from linesift.operators import encoding as enc
from linesift.sources.files import _open, sized_for_loading

RANGE_BYTES = 64 << 20
#: A line is one row of the result, so it can't be longer.
LINE_BYTES = 1 << 30
#: Bytes looked through together for a place to cut.
PIECE = 1 << 16
#: Ranges that one task reads at least, however short they are, before more tasks are made for them.
TASK_RANGES = 2_000
#: Characters of decoded ranges that go to Spark together.
BATCH_CHARS = 4 << 20
#: Rows of this module's results: a file, or the lines that begin in one of its ranges.  Null ``text``: skipped or failed.
TEXTS = "file_path string, encoding string, before long, text string, skipped boolean, stage string, message string"
NOT_DECODED = "no candidate encoding decodes the file"

# Encodings of several bytes whose bytes 10 and 13 are always line ends.
MULTIBYTE = frozenset(
    "utf-8 utf-8-sig cp932 shift_jis shift_jis_2004 shift_jisx0213 euc_jp euc_jis_2004 euc_jisx0213 gb18030 gbk gb2312 "
    "big5 big5hkscs cp950 euc_kr cp949 johab".split()
)
# The escapes of ISO-2022-JP; the first one is the state at a file's start.
ESCAPES = (b"\x1b(B", b"\x1b(J", b"\x1b$@", b"\x1b$B")
_escape = re.compile(rb"\x1b(?:\([BJ]|\$[@B])")
_ends = re.compile(rb"[\r\n]")


@lru_cache(maxsize=256)
def kind(encoding: str) -> str | None:
    """How files in an encoding are cut: at line ends (``bytes``), as UTF-16 (``wide``), with a state (``escapes``), or not
    at all (``whole``); None if Python doesn't know it."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError:
        return None
    if name in MULTIBYTE:
        return "bytes"
    if name in ("utf-16", "utf-16-le", "utf-16-be"):
        return "wide"
    if name == "iso2022_jp":
        return "escapes"
    try:  # one byte, one character: a table that keeps the line ends
        table = [bytes([b]).decode(encoding, "ignore") for b in range(256)]
        if all(len(c) <= 1 for c in table) and table[10] == "\n" and table[13] == "\r" and "\n" not in table[:10] + table[11:]:
            return "bytes" if len(bytes(range(256)).decode(encoding, "replace")) == 256 else "whole"
    except (UnicodeError, TypeError, LookupError):
        pass
    return "whole"


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that a normal form may join to the one before, though they are no marks."""
    found = {chr(c) for lo, hi in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(lo, hi)}  # Hangul vowels and finals
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            last = chr(int(parts[1], 16))
            if not unicodedata.combining(last):
                found.add(last)
    return frozenset(found)


def _safe(c: str) -> bool:
    """Whether a text may be cut in front of ``c``: never inside a line end or a joined character."""
    return c != "\n" and not unicodedata.combining(c) and c not in _joining()


class Bytes:
    """A file of a listed length, read by position."""

    def __init__(self, uri: str, size: int):
        filesystem, place = _open(uri)
        self.size = size
        self.file = filesystem.open_input_file(place)

    def read(self, lo: int, hi: int) -> bytes:
        lo, hi = max(0, lo), min(hi, self.size)
        if hi <= lo:
            return b""
        self.file.seek(lo)
        found = self.file.read(hi - lo)
        if len(found) < hi - lo:
            raise OSError(f"the file ends at byte {lo + len(found)}, it was listed with {self.size}")
        return found

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def line_start(self, p: int) -> int:
        """The first line that begins at ``p`` or behind it, where bytes 10 and 13 end lines."""
        if p <= 0:
            return 0
        at = p - 1
        while at < self.size:
            piece = self.read(at, at + PIECE)
            if m := _ends.search(piece):
                q = at + m.start()
                return q + 2 if piece[m.start()] == 13 and self.read(q + 1, q + 2) == b"\n" else q + 1
            at += len(piece)
            if at - p > LINE_BYTES:
                raise ValueError(f"a line is longer than {LINE_BYTES} bytes")
        return self.size

    def wide_cut(self, p: int, order: str) -> int:
        """The first place from ``p`` on where a text in UTF-16 may be cut."""
        at = p + (p & 1)
        if p <= 0:
            return 0
        while at < self.size:
            piece = self.read(at, at + PIECE + 2)
            for i in range(0, min(PIECE, len(piece) - 1), 2):
                unit = int.from_bytes(piece[i : i + 2], order)
                if 0xDC00 <= unit < 0xE000:
                    continue
                c = piece[i : i + (4 if 0xD800 <= unit < 0xDC00 else 2)].decode(f"utf-16-{order[0]}e", "replace")
                if c and _safe(c[0]):
                    return at + i
            at += PIECE
        return self.size

    def wide_line_start(self, p: int, order: str) -> int:
        """The first line that begins at the cut ``p`` or behind it, in UTF-16."""
        if p <= 0 or p >= self.size:
            return max(0, min(p, self.size))
        at, codec = p - 2, f"utf-16-{order[0]}e"
        new, ret = "\n".encode(codec), "\r".encode(codec)
        while at < self.size:
            piece = self.read(at, at + PIECE)
            found = [i for mark in (new, ret) if (i := _aligned(piece, mark)) >= 0]
            if found:
                q = at + min(found)
                return q + 4 if self.read(q, q + 4) == ret + new else q + 2
            at += len(piece)
            if at - p > LINE_BYTES:
                raise ValueError(f"a line is longer than {LINE_BYTES} bytes")
        return self.size

    def order(self, encoding: str) -> str:
        name = codecs.lookup(encoding).name
        return "big" if name == "utf-16-be" or (name == "utf-16" and self.read(0, 2) == b"\xfe\xff") else "little"


def _aligned(piece: bytes, mark: bytes) -> int:
    i = piece.find(mark)
    while i >= 0 and i & 1:
        i = piece.find(mark, i + 1)
    return i


def _breaks(text: str) -> int:
    return text.count("\n") + text.count("\r") - text.count("\r\n")


def _counts(text: str, encoding: str, again: int | None, lines: int, entry: bytes | None) -> dict:
    return {"entry": entry, "n": len(text), "script2": enc._script2(text, enc._BONUS.get(encoding)), "ascii": text.isascii(),
            "nfc": len(unicodedata.normalize("NFC", text)), "again": again, "lines": lines}


def _again(text: str, codec: str) -> int | None:
    try:
        return len(text.encode(codec))
    except UnicodeError:
        return None


def range_facts(file: Bytes, k: int, start: int, stop: int, encodings: Sequence[str]) -> tuple[list[list[dict]], bytes | None]:
    """For each encoding the counts of a range (none if it can't be decoded; one for each state it may begin in), and its last escape."""
    lo, hi = file.line_start(start), file.line_start(stop)
    raw = file.read(lo, hi)
    out = []
    for e in encodings:
        found, how = [], kind(e)
        try:
            if how == "wide":
                order = file.order(e)
                a, b = file.wide_cut(start, order), file.wide_cut(stop, order)
                codec = e if k == 0 else f"utf-16-{order[0]}e"
                text = file.read(a, b).decode(codec)
                before = file.read(a - 2, a).decode(f"utf-16-{order[0]}e", "replace") if k else "\n"
                lines = (before in ("\n", "\r")) + _breaks(text) - text.endswith(("\n", "\r")) if text else 0
                found.append(_counts(text, e, _again(text, codec), lines, None))
            elif how == "escapes":
                for entry in ESCAPES if k else ESCAPES[:1]:
                    try:
                        text = (entry + raw).decode(e)
                    except UnicodeError:
                        continue
                    found.append(_counts(text, e, _again(text, e), _breaks(text) + bool(text and not text.endswith(("\n", "\r"))), entry))
            elif how is not None:
                codec = "utf-8" if k and codecs.lookup(e).name == "utf-8-sig" else e
                text = raw.decode(codec)
                found.append(_counts(text, e, _again(text, codec), _breaks(text) + bool(text and not text.endswith(("\n", "\r"))), None))
        except UnicodeError:
            pass
        out.append(found)
    escapes = _escape.findall(raw)
    return out, escapes[-1] if escapes else None


def range_text(file: Bytes, start: int, stop: int, encoding: str, entry: bytes) -> str:
    """The lines that begin in a range."""
    how = kind(encoding)
    if how == "wide":
        order = file.order(encoding)
        a, b = (file.wide_line_start(file.wide_cut(p, order), order) for p in (start, stop))
        return file.read(a, b).decode(encoding if a == 0 else f"utf-16-{order[0]}e")
    raw = file.read(file.line_start(start), file.line_start(stop))
    if how == "escapes":
        return (entry + raw).decode(encoding)
    return raw.decode("utf-8" if start and codecs.lookup(encoding).name == "utf-8-sig" else encoding)


FACT = "struct<entry: binary, n: bigint, script2: bigint, `ascii`: boolean, nfc: bigint, again: bigint, lines: bigint>"


def _fact_type():
    return pa.struct([("entry", pa.binary()), ("n", pa.int64()), ("script2", pa.int64()), ("ascii", pa.bool_()), ("nfc", pa.int64()), ("again", pa.int64()), ("lines", pa.int64())])


def _said(path: str, error: Exception) -> str:
    return f"Error accessing file {path}: {error}"


# ------------------------------------------------------------------------------------------------ files of one range
def whole_texts(files: DataFrame, encodings: Sequence[str], prefer_utf8: bool = True) -> DataFrame:
    """``path, file_path, length`` -> TEXTS: a row for each file, each opened and read once."""
    names = list(encodings)
    facts = pa.list_(pa.struct([("ord", pa.int32()), ("encoding", pa.string()), ("n", pa.int64()), ("script2", pa.int64()), ("ascii", pa.bool_()), ("nfc", pa.int64()), ("again", pa.int64())]))
    fields = [("file_path", pa.string()), ("text", pa.string()), ("sig", pa.bool_()), ("content", pa.binary()), ("facts", facts), ("skipped", pa.bool_()), ("message", pa.string())]
    schema = pa.schema(fields)

    def loaded(path: str, name: str) -> tuple:
        try:
            filesystem, place = _open(path)
            with filesystem.open_input_stream(place) as f:
                content = f.read()
        except Exception as e:  # noqa: BLE001 - a row of the errors; the scan goes on
            return name, None, False, None, None, False, _said(name, e)
        if b"\0" in content[: enc.NUL_SPAN]:
            return name, None, False, None, None, True, None
        sig = content.startswith(codecs.BOM_UTF8)
        if prefer_utf8 or sig or not content:
            try:
                return name, content.decode("utf-8-sig"), sig, None, None, False, None
            except UnicodeError:
                pass
        return name, None, sig, content, enc._facts(content, names), False, None

    def run(batches: Iterator):
        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            rows, size = [], 0
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(loaded(path, name))
                size += len(rows[-1][1] or rows[-1][3] or "")
                if size >= RANGE_BYTES:
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)

    types = f"file_path string, text string, sig boolean, content binary, facts {enc.FACTS_TYPE}, skipped boolean, message string"
    found = files.select("path", "file_path").mapInArrow(run, types)
    found = found.withColumn("ranked", enc.ranked_candidates(F.col("facts"), F.length("content"))).withColumn("chosen", enc.chosen_encoding(F.col("sig"), enc.is_valid_utf8("content")))

    # Only bytes that are not UTF-8 go back to Python: the columns are null for all other rows.
    @F.arrow_udf("string")
    def decoded(content: pa.Array, encoding: pa.Array) -> pa.Array:
        if pc.all(pc.is_null(encoding)).as_py():
            return pa.nulls(len(content), pa.string())
        return pa.array([None if e is None else c.as_py().decode(e) for c, e in zip(content, encoding.to_pylist(), strict=True)], pa.string())

    native = F.col("text").isNotNull()
    failed = F.col("content").isNotNull() & F.col("chosen").isNull()
    found = found.withColumn("other", decoded("content", "chosen"))
    return found.select(
        "file_path",
        F.when(native, F.when(F.col("sig"), "utf-8-sig").otherwise("utf-8")).otherwise(F.col("chosen")).alias("encoding"),
        F.lit(0).cast("long").alias("before"),
        F.coalesce("text", "other").alias("text"),
        "skipped",
        F.when(F.col("message").isNotNull(), "read").when(failed, "decode").alias("stage"),
        F.coalesce("message", F.when(failed, NOT_DECODED)).alias("message"),
    )


# ------------------------------------------------------------------------------------------------ files of many ranges
def byte_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """``path, file_path, length, k, start, stop``: a row for each range."""
    last = F.greatest(F.ceil(F.col("length") / F.lit(range_bytes)) - 1, F.lit(0)).cast("long")
    rows = files.select("path", "file_path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return rows.withColumns({"start": F.col("k") * range_bytes, "stop": F.least((F.col("k") + 1) * range_bytes, F.col("length"))})


def counted_ranges(ranges: DataFrame, encodings: Sequence[str]) -> DataFrame:
    """``ranges`` with the counts of each encoding (``facts``), the last escape, the tests of the file's first bytes, or a message."""
    names = list(encodings)
    kept = ["path", "file_path", "length", "k", "start", "stop"]
    types = [pa.list_(pa.list_(_fact_type())), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]

    def counted(path, name, size, k, start, stop):
        try:
            with Bytes(path, size) as f:
                head = f.read(0, enc.NUL_SPAN)
                if b"\0" in head:
                    return None, None, True, False, None
                facts, escape = range_facts(f, k, start, stop, names)
                return facts, escape, False, head.startswith(codecs.BOM_UTF8), None
        except Exception as e:  # noqa: BLE001 - a row of the errors; the scan goes on
            return None, None, False, False, _said(name, e)

    def run(batches: Iterator):
        for batch in batches:  # only counts come out of it
            found = [counted(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            new = [pa.array(v, t) for v, t in zip(zip(*found, strict=True) if found else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, "facts", "escape", "skipped", "sig", "message"])

    schema = f"path string, file_path string, length long, k long, start long, stop long, facts array<array<{FACT}>>, escape binary, skipped boolean, sig boolean, message string"
    return ranges.select(*kept).mapInArrow(run, schema)


def judged_ranges(counted: DataFrame, encodings: Sequence[str], prefer_utf8: bool = True) -> DataFrame:
    """``counted`` with each file's verdict (``chosen``, ``message``, ``stage``), the state that a range begins in, and the lines before it.

    The last of ``encodings`` is UTF-8 by itself, whether a candidate or not.
    """
    whole = Window.partitionBy("path")
    order = whole.orderBy("k")
    rows = counted.withColumn("entry", F.coalesce(F.last("escape", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(bytearray(ESCAPES[0]))))
    fits = lambda i: F.get(F.filter(F.get("facts", F.lit(i)), lambda x: x["entry"].isNull() | (x["entry"] == F.col("entry"))), F.lit(0))
    rows = rows.withColumns({f"f{i}": fits(i) for i in range(len(encodings))})
    n = F.count(F.lit(1)).over(whole)
    total = []
    for i, e in enumerate(encodings[:-1]):
        f = F.col(f"f{i}")
        add = lambda c, f=f: F.sum(f[c]).over(whole)
        again = F.when(F.count(f["again"]).over(whole) == n, add("again"))
        fact = F.struct(F.lit(i).alias("ord"), F.lit(e).alias("encoding"), add("n").alias("n"), add("script2").alias("script2"), F.min(f["ascii"]).over(whole).alias("ascii"), add("nfc").alias("nfc"), again.alias("again"))
        total.append(F.when(F.count(f).over(whole) == n, fact))
    valid = F.count(f"f{len(encodings) - 1}").over(whole) == n
    rows = rows.withColumns({"totals": F.array_compact(F.array(*total)), "valid": valid, "message": F.min("message").over(whole)})
    rows = rows.withColumn("ranked", enc.ranked_candidates(F.col("totals"), F.col("length")))
    native = F.col("valid") & (F.col("sig") | F.lit(prefer_utf8))
    chosen = F.when(native, F.when(F.col("sig"), "utf-8-sig").otherwise("utf-8")).otherwise(enc.chosen_encoding(F.col("sig"), F.col("valid")))
    rows = rows.withColumn("chosen", F.when(F.col("message").isNull() & ~F.col("skipped"), chosen))
    lines = F.coalesce(*[F.when(F.col("chosen") == e, F.col(f"f{i}.lines")) for i, e in enumerate(encodings)], F.col(f"f{len(encodings) - 1}.lines"), F.lit(0))
    rows = rows.withColumn("before", F.coalesce(F.sum(lines).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    failed = F.col("message").isNull() & ~F.col("skipped") & F.col("chosen").isNull()
    rows = rows.withColumns({"stage": F.when(F.col("message").isNotNull(), "read").when(failed, "decode"), "message": F.coalesce("message", F.when(failed, NOT_DECODED))})
    return rows.select("path", "file_path", "length", "k", "start", "stop", "entry", "chosen", "before", "skipped", "stage", "message")


def ranged_texts(files: DataFrame, encodings: Sequence[str], range_bytes: int, prefer_utf8: bool = True, tasks: int | None = None) -> DataFrame:
    """``path, file_path, length`` -> TEXTS: a row for the lines of each range; one row for a file that has no text.

    A range that can no longer be read when its file's verdict stands fails the task: it is tried again, and never lost.
    """
    names = [*encodings, "utf-8"]
    n = tasks or files.sparkSession.sparkContext.defaultParallelism
    # Rows are tiny, the bytes behind them are not: the number of tasks is given, so it isn't cut down to the rows' size.
    judged = judged_ranges(counted_ranges(byte_ranges(files, range_bytes).repartition(n, "path", "k"), names), names, prefer_utf8)
    judged = judged.where(F.col("chosen").isNotNull() | (F.col("k") == 0)).repartition(n, "path", "k")
    kept = ["path", "length", "start", "stop", "entry", "file_path", "chosen", "before", "skipped", "stage", "message"]

    def run(batches: Iterator):
        def emit(batch, texts, stop):
            cols = [batch.column(j).slice(stop - len(texts), len(texts)) for j in range(5, 11)]
            return pa.RecordBatch.from_arrays([*cols[:3], pa.array(texts, pa.string()), *cols[3:]], names=[x.split()[0] for x in TEXTS.split(", ")])

        for batch in batches:
            texts, held = [], 0
            for i, (path, size, start, stop, entry, _, encoding, *_) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if texts and held + stop - start > BATCH_CHARS:  # a long range comes alone
                    yield emit(batch, texts, i)
                    texts, held = [], 0
                text = None
                if encoding is not None:
                    with Bytes(path, size) as f:
                        text = range_text(f, start, stop, encoding, entry)
                texts.append(text)
                held += len(text or "")
            if texts:
                yield emit(batch, texts, batch.num_rows)

    return judged.select(*kept).mapInArrow(run, TEXTS)


def range_tasks(spark, total: int, n: int, range_bytes: int) -> int:
    """Tasks for the ranges of ``n`` files of ``total`` bytes: by their bytes, and for short ranges by their number."""
    ranges = -(-total // range_bytes) + n  # every file's last range may be short
    tasks = max(-(-total // max(range_bytes, RANGE_BYTES)), -(-ranges // TASK_RANGES))
    return max(spark.sparkContext.defaultParallelism, min(100_000, tasks))


def text_files(files: DataFrame, encodings: Sequence[str] = enc.ENGINE_ENCODINGS, range_bytes: int = RANGE_BYTES, prefer_utf8: bool = True, stats: tuple[int, int] | None = None, long_stats: tuple[int, int] | None = None) -> DataFrame:
    """A listing (``path, file_path, length``) -> TEXTS.  ``range_bytes`` changes nothing in the result but how the text is dealt to rows.

    ``stats`` and ``long_stats``: bytes and number of the files up to ``range_bytes`` and above, where known.
    """
    if any(kind(e) == "whole" for e in encodings):
        return whole_texts(sized_for_loading(files, stats=stats), encodings, prefer_utf8)
    files = files.select("path", "file_path", F.coalesce("length", F.lit(0)).alias("length"))
    short = sized_for_loading(files.where(F.col("length") <= range_bytes), stats=stats)
    out = whole_texts(short, encodings, prefer_utf8)
    if long_stats is not None and not long_stats[1]:
        return out
    long = files.where(F.col("length") > range_bytes)
    if long_stats is None:
        row = long.agg(F.sum("length").alias("b"), F.count(F.lit(1)).alias("n")).first()
        long_stats = (int(row["b"] or 0), int(row["n"]))
        if not long_stats[1]:
            return out
    return out.unionByName(ranged_texts(long, encodings, range_bytes, prefer_utf8, range_tasks(files.sparkSession, *long_stats, range_bytes)))


def text_lines(texts: DataFrame) -> DataFrame:
    """TEXTS -> ``file_path, line_number, raw``."""
    rows = texts.where(F.col("text").isNotNull())
    rows = rows.select("file_path", "before", F.posexplode(line_pieces(F.col("text"))).alias("pos", "raw"))
    return rows.select("file_path", (F.col("before") + F.col("pos") + 1).cast("int").alias("line_number"), "raw")


def text_errors(texts: DataFrame) -> DataFrame:
    """TEXTS -> ``file_path, stage, message`` of the files that could not be read or decoded."""
    return texts.where(F.col("stage").isNotNull()).select("file_path", "stage", "message")
