"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0.  On each level runs of equal symbols become one symbol; deterministic coin
tossing gives each symbol a label from itself and its neighbours on the left (the lowest bit in which two neighbours
differ, and its value, again and again until six labels are left); local maxima of the labels open phrases; a phrase's
name is a hash of its symbols, and the names are the symbols of the next level.  All of it looks a few symbols around,
so equal substrings get equal phrases inside, wherever they stand.

The fingerprint holds the 64 smallest 32-bit names among the phrases of level ``LEVEL`` and above, and of each lower
level on which the text has 64 phrases at most (so a short text keeps its short phrases).  The two low bits of a name
are its level, 3 for all from there on.  The likeness of two fingerprints estimates the Jaccard similarity of the names
of the levels that both hold.

Defined results: a null text is an empty one; empty texts share one fingerprint; rows with equal keys are ordered by
their text, rows with a null key come last; with one row the next document is the row itself; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesift.llm import textblock as T
from linesift.llm.stage import stage

LEVEL, KEEP = 3, 64
#: The bits of a name that hold its level.
CLASS = np.uint64(3)
#: Bytes of texts parsed together.
PARSE_BYTES = 1 << 20


def _toss(width: int) -> np.ndarray:
    """Table of new labels for pairs (left, own) of labels below ``width``."""
    a, b = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    x = a ^ b
    low = np.where(x > 0, np.log2(np.maximum(x & -x, 1)).astype(int), 0)
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).reshape(-1)


#: Label ranges: 256 byte values -> 16 -> 8 -> 6, and 64-bit names -> 128 -> 14 -> 8 -> 6.
_TABLES = {w: _toss(w) for w in (256, 128, 16, 8)}
_BIT = np.zeros(67, np.uint8)
_BIT[[pow(2, i, 67) for i in range(64)]] = np.arange(64)


def _relabel(labels: np.ndarray, width: int, start: np.ndarray) -> np.ndarray:
    at = np.empty(len(labels), np.uint32)
    at[0] = 0
    np.multiply(labels[:-1], width, out=at[1:], dtype=np.uint32, casting="unsafe")
    at += labels
    out = _TABLES[width][at]
    out[start] = labels[start] & 1
    return out


def _name_labels(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    x = names.copy()
    x[1:] ^= names[:-1]
    x[0] = 1
    low = x & (~x + np.uint64(1))
    bit = _BIT[low % np.uint64(67)]  # powers of two differ modulo 67
    out = 2 * bit + ((names & low) != 0)
    out[start] = (names[start] & np.uint64(1)).astype(np.uint8)
    return out.astype(np.uint8)


def _starts(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(doc, prepend=-1))


def parse(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: its number, phrase names, their documents, and which documents closed (have one phrase left)."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    if not len(doc):
        return
    first = np.zeros(len(data), bool)
    first[_starts(doc)] = True
    first[1:] |= data[1:] != data[:-1]
    at = np.flatnonzero(first)
    run = np.diff(at, append=len(data)).astype(np.uint64)
    symbols, doc = data[at], doc[at]
    names = T.mix(symbols.astype(np.uint64) + (run << np.uint64(8)) + np.uint64(1))
    start = _starts(doc)
    labels = _relabel(symbols, 256, start)
    level = 0
    while len(names):
        level += 1
        for width in (16, 8) if level == 1 else (128, 16, 8):
            labels = _relabel(labels, width, start)
        top = np.zeros(len(labels), bool)
        top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        top[start[1:] - 1] = False  # the last symbol of a document opens nothing
        top[start] = True
        lo = np.flatnonzero(top)
        hi = np.append(lo[1:], len(names))
        p, q = T._powers(1 << max(20, len(names).bit_length()))
        sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * p[: len(names)], out=sums[1:])
        names = T.mix((sums[hi] - sums[lo]) * q[lo] + (hi - lo).astype(np.uint64))
        doc = doc[lo]
        closed = np.bincount(doc, minlength=n) == 1
        yield level, names, doc, closed
        on = ~closed[doc]
        names, doc = names[on], doc[on]
        if not len(names):
            return
        # Runs of equal names are one symbol of the next level.
        first = np.ones(len(names), bool)
        first[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        run = np.diff(at, append=len(names)).astype(np.uint64)
        names = np.where(run > 1, T.mix(names[at] + run * np.uint64(T.STEP)), names[at])
        doc = doc[at]
        start = _starts(doc)
        labels = _name_labels(names, start)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted 32-bit names kept for each text."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    keys = []
    for level, names, doc, _closed in parse(np.frombuffer(b"".join(texts), np.uint8), offs):
        few = np.bincount(doc, minlength=len(texts)) <= KEEP
        on = np.ones(len(names), bool) if level >= LEVEL else few[doc]
        small = (names[on] >> np.uint64(32)) & ~CLASS | np.uint64(min(level, LEVEL))
        keys.append((doc[on].astype(np.uint64) << np.uint64(32)) | small)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    cut = np.searchsorted(found, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    small = (found & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [small[a : min(b, a + KEEP)] if b > a else np.zeros(1, ">u4") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the names of the union that both hold, over the levels of both and up to where both lists reach."""
    x, y = a.tolist(), b.tolist()
    if x == y:
        return 1.0
    lowest = max(min(v & 3 for v in x), min(v & 3 for v in y))
    reach = min(v[-1] if len(v) == KEEP else 1 << 32 for v in (x, y))
    x, y = ({v for v in names if v <= reach and v & 3 >= lowest} for names in (x, y))
    return len(x & y) / len(x | y) if x and y else 0.0


def hex_of(names: np.ndarray) -> str:
    return names.tobytes().hex()


def read_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4")


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``: one pass, no shuffle."""
    docs = docs.drop("fingerprint")
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found: list[str] = []
            for b in T.blocks(batch, text):
                found += map(hex_of, fingerprints([b.text(i) for i in range(b.n)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*kept, "fingerprint"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """``part, doc_id, text`` in range partitions of descending keys, equal keys by their text.

    Texts are shuffled once.  The bounds hold keys and 64 characters, so rows of one key, or without any, are split too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").desc_nulls_last()
    split = docs.repartitionByRange(n, key, F.substring("text", 1, 64)).sortWithinPartitions(key, "text")
    return split.select(F.spark_partition_id().alias("part"), "doc_id", "text")


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by as many from the start of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _judged(run: list[tuple[int | None, str]]) -> list[pa.Array]:
    """The columns of ``RESULT`` for all of ``run`` but its last row, which only is the next of the one before."""
    changed = [edited(t, o).encode() for (_, t), (_, o) in zip(run, run[1:], strict=False)]
    prints = fingerprints([t.encode() for _, t in run] + changed)
    own, after = prints[: len(run)], prints[len(run) :]
    m = len(changed)
    return [
        pa.array([k for k, _ in run[:m]], pa.int64()),
        pa.array([len(t) for _, t in run[:m]], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        pa.array([hex_of(x) for x in own[:m]], pa.string()),
        pa.array([hex_of(x) for x in after], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, after, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
    ]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of a partition but for its last row, and its first and last row as they are (``edge``)."""
    edges = [*NAMES, "part", "edge", "text"]

    def results(rows: list) -> pa.RecordBatch:
        m = len(rows) - 1
        return pa.RecordBatch.from_arrays([*_judged(rows), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string())], names=edges)

    def edge(name: str, row: tuple[int | None, str]) -> pa.RecordBatch:
        blank = [pa.nulls(1, a.type) for a in _judged([])[1:]]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *blank, pa.array([part], pa.int32()), pa.array([name]), pa.array([row[1]])], names=edges)

    held, size, part = [], 0, None
    for batch in batches:
        for p, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None:
                part = p
                yield edge("first", (key, text))
            held.append((key, text))
            size += len(text)
            if size > PARSE_BYTES and len(held) > 1:
                yield results(held)
                held, size = held[-1:], len(text)
    if held:
        if len(held) > 1:
            yield results(held)
        yield edge("last", held[-1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays(_judged([(key, text), (None, after)]), names=NAMES)


def compare_edited(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A partition judges its rows but the last one, whose next is the first row of the next partition; two rows of each
    partition meet in a join for that.
    """
    found = stage(neighbours(docs).mapInArrow(_runs, f"{RESULT}, part int, edge string, text string"), "fingerprint-runs")
    firsts, lasts = (found.where(F.col("edge") == name) for name in ("first", "last"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # a number for each partition, no texts
    parts = firsts.select("part", F.lead("part").over(order).alias("after"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("top"))
    parts = parts.select("part", F.coalesce("after", "top").alias("after"))
    ends = lasts.select("part", "doc_id", "text").join(parts, "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("other")), "after")
    return found.where("edge is null").select(*NAMES).unionAll(ends.select("doc_id", "text", "other").mapInArrow(_pairs, RESULT))
