"""Packing by cutting-stock column generation.

1. Documents are tokenised; one with more than ``capacity`` ids is cut into full pieces and a rest.
2. Spark counts the pieces by size class (``unit`` ids wide): a histogram of at most capacity/unit numbers.
3. The driver solves the cutting-stock linear program over patterns of classes: the revised simplex method holds one
   column per class, a knapsack dynamic programme prices new columns with the duals, and generation ends when the
   dual bound shows the gap to be below ``gap``.
4. Pattern counts are rounded down; what is left is filled in by best fit into further patterns.
5. Pieces are ranked inside their class, and the ranks are dealt to the patterns' places by arithmetic.

Only the histogram and the pattern table are held by the driver: both are bounded by the number of classes, whatever
the number of documents.

Defined results: a null text is an empty one and has only the end id; repeated rows are packed one by one; rows with a
null key are packed too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesift.llm.encoder import encoder
from linesift.llm.stage import numbered, ordered, stage

CAPACITY = 4096
#: Width of a size class in ids, and the relative gap at which column generation ends.
UNIT, GAP = 8, 1e-3
#: Texts encoded together, in characters.
BATCH_CHARS = 2_000_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def text_batches(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of about ``most`` characters; a null text is empty."""
    arr, lo, size, run = batch.column(batch.schema.get_field_index(column)), 0, 0, []
    for i, t in enumerate(arr):
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= most:
            yield lo, run
            lo, size, run = i + 1, 0, []
    if run:
        yield lo, run


def token_pieces(docs: DataFrame, path: str, end_id: int | None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of a document: where it starts, its length, the checksum of its ids, its document's ids."""

    def run(batches):
        enc, tail = encoder(path), b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0)
            for lo, texts in text_batches(batch, "text"):
                rows = []
                for i, ids in enumerate(enc.encode(texts)):
                    ids += tail
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        part = ids[4 * at : 4 * (at + capacity)]
                        rows.append((lo + i, at, len(part) // 4, zlib.crc32(part), n))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: an unbounded knapsack over classes 1..capacity (class = weight) with the duals as values."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = duals[1 : c + 1] + best[c - 1 :: -1] if c > 1 else duals[1:2] + best[:1]
        i = int(np.argmax(v))
        if v[i] > best[c - 1] + 1e-12:
            best[c], took[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve_patterns(demand: np.ndarray, gap: float = GAP, most: int = 20_000) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Columns of the cutting-stock program with their (fractional) counts, and a lower bound of the sum of counts.

    ``demand[w]`` pieces weigh w; the capacity is ``len(demand) - 1``.
    """
    capacity = len(demand) - 1
    sizes = np.flatnonzero(demand)
    sizes = sizes[sizes > 0]
    m = len(sizes)
    if not m:
        return [], 0.0
    fit = capacity // sizes
    columns = [np.where(np.arange(m) == i, fit[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / fit)
    x = demand[sizes] / fit
    bound = float(demand[sizes] @ sizes) / capacity
    for _ in range(most):
        duals = np.zeros(capacity + 1)
        dual = inverse.sum(axis=0)
        duals[sizes] = np.maximum(dual, 0.0)
        value, pattern = price(duals, capacity)
        # Farley's bound: the duals divided by the best pattern's value are feasible.
        bound = max(bound, float(duals[sizes] @ demand[sizes]) / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        a = pattern[sizes]
        d = inverse @ a
        pos = d > 1e-10
        if not pos.any():
            break
        ratio = np.full(m, np.inf)
        ratio[pos] = x[pos] / d[pos]
        r = int(np.argmin(ratio))
        step = ratio[r]
        x -= step * d
        x[r] = step
        np.maximum(x, 0.0, out=x)
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        columns[r] = a
    out = []
    for a, k in zip(columns, x, strict=True):
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = a
        out.append((full, float(k)))
    return out, bound


def round_patterns(demand: np.ndarray, columns: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that use each piece exactly once: rounded down, the rest by best fit decreasing."""
    left, out, capacity = demand.astype(np.int64).copy(), [], len(demand) - 1
    for a, k in columns:
        used = np.flatnonzero(a)
        n = int(min([k + 1e-9, *(left[used] // a[used])])) if len(used) else 0
        if n > 0:
            out.append((a, n))
            left -= n * a
    # The rest has less than one pattern per column.  A full pattern is repeated while the counts allow.
    while left.any():
        room, a, avail = capacity, np.zeros_like(left), left.copy()
        while room > 0 and (fits := np.flatnonzero(avail[1 : room + 1])).size:
            w = int(fits[-1]) + 1
            n = min(room // w, int(avail[w]))
            a[w] += n
            avail[w] -= n
            room -= n * w
        used = np.flatnonzero(a)
        n = int((left[used] // a[used]).min())
        out.append((a, n))
        left -= n * a
    return out


def places(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, end rank, first sequence, pieces per sequence, order in the sequence)."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for a, n in patterns:
        for order, w in enumerate(np.flatnonzero(a)[::-1].tolist()):
            lo = taken.get(w, 0)
            taken[w] = hi = lo + n * int(a[w])
            rows.append((w, lo, hi, seq, int(a[w]), order))
        seq += n
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, gap: float = GAP) -> DataFrame:
    """``pieces`` (columns doc_id, start, length, more) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("_class", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
    staged = ordered(sized, ["_class", "doc_id", "start"], "packing-pieces")
    demand = np.zeros(-(-capacity // unit) + 1, np.int64)
    for w, n in staged.groupBy("_class").count().collect():
        demand[w] = n
    columns, _ = solve_patterns(demand.astype(float), gap)
    table = places(round_patterns(demand, columns))
    deal = spark.createDataFrame(table, "w int, lo long, hi long, seq long, per long, turn int")
    ranked = numbered(staged, ["_class"])
    # A class has as many runs of ranks as patterns that hold it: the table has a bounded number of rows.
    at = ranked.join(F.broadcast(deal), (F.col("_class") == F.col("w")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    t = F.col("_rank") - F.col("lo")
    at = at.withColumn("sequence_id", F.col("seq") + F.call_function("div", t, F.col("per"))).withColumn("_turn", F.struct("turn", (t % F.col("per")).alias("k")))
    # At most ``capacity`` pieces share a sequence.
    before = Window.partitionBy("sequence_id").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int | None = 2, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text).  Pieces are staged, so each text is tokenised once."""
    pieces = stage(token_pieces(docs, path, end_id, capacity), "packing-tokens")
    return pack_pieces(pieces, capacity, unit)
