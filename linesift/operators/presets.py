"""Preset search: one preset by label (L8) and all presets in one pass (L9).

The scan of a few patterns tests every segment against every pattern inside one
projection (``array(when(rlike ...))`` then ``explode``): one scan, no join,
no shuffle.

Patterns held in a table, any number of them, are indexed by their guards: the literal that every match of a pattern
holds (``required_literal``).  A pattern is filed under one gram of its guard, the one that the fewest patterns have: six
characters that follow each other, or three where the guard is shorter.  The distinct grams of a line fetch candidates
by an equi-join, and only these run, guard first.  A line is cut into all its grams only where the index is too large to
be sent around; otherwise the filed ones are looked for in it.  Patterns without a guard of three characters are tested
inside the projection, ``SLICE`` of them in a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from linesift.operators.grep import compile_search, grep
from linesift.sources.presets import by_label, preset_list

SLICE = 256  # patterns without a guard in one projection
SMALL_INDEX = 200_000  # filed patterns that are sent to every task at most; more of them are joined by a shuffle
GRAM, LONG_GRAM = 3, 6  # characters of a key; a guard that has as many is filed under a long one, which few lines share
FEW_KEYS = 64  # filed grams that a line is searched for one by one at most
BLOCK = 1 << 20  # bytes of lines looked through together
ODD = 0x9E3779B97F4A7C15  # fixed odd multiplier (arbitrary): hashes the first bytes of a key


def grep_preset(segments: DataFrame, label: str, ignore_case: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Search with the first preset of this label; an unknown label searches the empty literal."""
    pattern, is_regex = by_label(label)
    return grep(segments, pattern, regex=is_regex, ignore_case=ignore_case, keep=keep)


def _scan(segments: DataFrame, patterns: list[tuple[str, int, str, str, bool]], keep: tuple[str, ...]) -> DataFrame:
    checks = []
    for category, ord_, label, pattern, is_regex in patterns:
        s = compile_search(pattern, regex=is_regex)
        tag = F.struct(F.lit(category).alias("category"), F.lit(ord_).alias("ord"), F.lit(label).alias("label"))
        checks.append(F.when(s.predicate(F.col("raw")), tag))
    if not checks:
        return segments.select("file_path", "line_number", "location_display", *keep).where(F.lit(False)).select(
            "*", F.lit("").alias("category"), F.lit(0).alias("ord"), F.lit("").alias("label")
        )
    # exploded as it is and filtered after: a filter on the array before would run every regex twice
    return (
        segments.select("file_path", "line_number", "location_display", *keep, F.explode(F.array(*checks)).alias("p"))
        .where(F.col("p").isNotNull())
        .select("file_path", "line_number", "location_display", *keep, "p.category", "p.ord", "p.label")
    )


def preset_scan(segments: DataFrame, patterns=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (segment, matching preset): ``file_path, line_number, location_display, category, ord, label``."""
    return _scan(segments, preset_list() if patterns is None else patterns, keep)


def guarded_patterns(patterns_df: DataFrame) -> DataFrame:
    """``category, ord, label, pattern, is_regex`` with ``regex`` (Java form, null for a literal) and ``guard`` (or null)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [compile_search(p or "", regex=bool(r)) for p, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            guards = [s.guard if s.regex is not None else s.needle for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.regex for s in found], pa.string()), pa.array(guards, pa.string())],
                                             names=["category", "ord", "label", "pattern", "is_regex", "regex", "guard"])

    rows = patterns_df.select("category", F.col("ord").cast("int").alias("ord"), "label", "pattern", "is_regex")
    return rows.mapInArrow(run, "category string, ord int, label string, pattern string, is_regex boolean, regex string, guard string")


def grams(text, size: int) -> Column:
    """Every ``size`` characters that follow each other, once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), 1))


def pattern_index(guarded: DataFrame) -> DataFrame:
    """``key`` and a pattern's columns: each pattern with a guard of ``GRAM`` characters or more under one gram."""
    guard = F.col("guard")
    rows = guarded.where(F.length(guard) >= GRAM)
    each = rows.select("*", F.explode(F.when(F.length(guard) >= LONG_GRAM, grams(guard, LONG_GRAM)).otherwise(grams(guard, GRAM))).alias("key"))
    each = each.where(guard.contains(F.col("key")))  # a gram that begins inside a surrogate pair stands in no text
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("key", F.struct("n", "key")).alias("key")
    names = ["category", "ord", "label", "pattern", "is_regex", "regex", "guard"]
    # Equal rows of the table are one pattern each: they are counted and dealt out again.
    filed = each.join(shared, "key").groupBy(*names).agg(best, (F.count(F.lit(1)) / F.countDistinct("key")).cast("int").alias("times"))
    return filed.select("key", *names, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).drop("_copy")


def _key_finder(keys: list[str]):
    """``find(lines)``: the numbers of the lines that may hold a key, rising, and of the keys, each pair once.

    The lines' bytes are looked through side by side for the first bytes of the keys, as many as a key has characters.
    """
    import numpy as np

    tables = []
    for size in sorted({len(k) for k in keys}):
        own = np.array([i for i, k in enumerate(keys) if len(k) == size])
        heads = np.array([int.from_bytes(keys[i].encode()[:size], "little") for i in own], np.uint64)
        order = np.argsort(heads, kind="stable")
        known, first, times = np.unique(heads[order], return_index=True, return_counts=True)
        maybe = np.zeros(1 << 22, bool)
        maybe[(known * np.uint64(ODD)) >> np.uint64(42)] = True
        tables.append((size, own[order], known, first, times, maybe))

    def find(lines):
        arr = lines.cast("large_string")
        offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        buf = arr.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
        pairs = [np.zeros(0, np.int64)]
        for size, own, known, first, times, maybe in tables:
            for lo in range(int(offs[0]), int(offs[-1]), BLOCK):
                block = data[lo : min(lo + BLOCK + size - 1, int(offs[-1]))]
                n = len(block) - size + 1
                if n <= 0:
                    continue
                value = np.zeros(n, np.uint64)
                for k in range(size):
                    value |= block[k : k + n].astype(np.uint64) << np.uint64(8 * k)
                at = np.flatnonzero(maybe[(value * np.uint64(ODD)) >> np.uint64(42)])
                value = value[at]
                which = np.minimum(np.searchsorted(known, value), len(known) - 1)
                line = np.searchsorted(offs, at + lo, "right") - 1
                held = (known[which] == value) & (at + lo + size <= offs[line + 1])
                pair = np.unique(line[held] * len(known) + which[held])
                line, which = pair // len(known), pair % len(known)
                number = times[which]
                inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                pairs.append(np.repeat(line, number) * len(keys) + own[np.repeat(first[which], number) + inside])
        found = np.unique(np.concatenate(pairs))  # a line may lie in two blocks
        return found // len(keys), found % len(keys)

    return find


def with_keys(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The segments that may hold some of the keys, and which: an array ``keys``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        find, names = _key_finder(keys), pa.array(keys, pa.string())
        for batch in batches:
            line, which = find(batch.column("raw"))
            rows, begins = np.unique(line, return_index=True)
            found = pa.ListArray.from_arrays(pa.array(np.append(begins, len(line)), pa.int32()), names.take(pa.array(which)))
            held = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*held.columns, found], names=[*batch.schema.names, "keys"])

    return segments.mapInArrow(run, StructType([*segments.schema.fields, StructField("keys", ArrayType(StringType()))]))


def _candidates(rows: DataFrame, index: DataFrame) -> list[DataFrame]:
    """The rows with each filed gram (``key``) that they may hold, joined to the patterns filed under it."""
    keys = sorted(r["key"] for r in index.select("key").distinct().limit(SMALL_INDEX + 1).collect())
    raw, explode = F.col("raw"), lambda found: F.explode(found).alias("key")
    if len(keys) > SMALL_INDEX:
        sizes = sorted(r["size"] for r in index.select(F.length("key").alias("size")).distinct().collect())
        return [rows.select("*", explode(grams(raw, size))).join(index, "key") for size in sizes]
    if index.count() <= SMALL_INDEX:
        index = F.broadcast(index)
    if len(keys) > FEW_KEYS:
        return [with_keys(rows, keys).select(*rows.columns, explode(F.col("keys"))).join(index, "key")]
    return [rows.select("*", explode(F.array(*(F.when(raw.contains(k), F.lit(k)) for k in keys)))).join(index, "key")] if keys else []


def preset_scan_table(segments: DataFrame, patterns_df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The scan of :func:`preset_scan` for any number of patterns held in a ``patterns`` frame."""
    from linesift.session import written

    guarded = written(guarded_patterns(patterns_df), "patterns")
    index = written(pattern_index(guarded), "pattern-index")
    place = ["file_path", "line_number", "location_display", *keep]
    fits = F.col("raw").contains(F.col("guard")) & (F.col("regex").isNull() | F.rlike("raw", F.col("regex")))
    others = [(r["category"], r["ord"], r["label"], r["pattern"], r["is_regex"]) for r in guarded.where("guard is null or length(guard) < 3").collect()]
    others.sort(key=lambda r: (r[0], r[1]))
    parts = [held.where(fits).select(*place, "category", "ord", "label") for held in _candidates(segments.select(*place, "raw"), index)]
    parts += [_scan(segments, others[i : i + SLICE], keep) for i in range(0, len(others), SLICE)]
    return reduce(DataFrame.unionByName, parts or [_scan(segments, [], keep)])


def preset_counts(scan: DataFrame, patterns_df: DataFrame) -> DataFrame:
    """Hits per preset, zero-hit presets kept: ``category, label, hits``."""
    counts = scan.groupBy("category", "label").agg(F.count(F.lit(1)).alias("hits"))
    return (
        patterns_df.select("category", "label")
        .join(counts, ["category", "label"], "left")
        .select("category", "label", F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"))
    )
