"""Target-distribution importance resampling: documents drawn as if from the distribution of a target corpus.

1. A text's features are the runs of ``lo`` to ``hi`` consecutive words, each hashed to one of ``buckets`` buckets.  Every
   task counts its texts into an array; Spark adds the arrays up, so ``buckets`` rows reach the driver, whatever the input.
2. A bucket's gain is the floored, scaled log ratio of its smoothed shares in the target and in the documents.  The
   array of gains travels with the tasks, which look up a text's features in it and take the floored mean: its weight.
3. The score adds Gumbel noise from a keyed hash of the id, so the highest scores are a draw without replacement in
   proportion to exp(weight).  Scores are written once, as a few numbers for each document.
4. The cut-off is found by bisection of numbers: jobs count exactly how many written scores reach each probe, then how
   many ids of the tied score lie below each probe, then rows of a tied id.  Nothing is sorted for it.
5. Only the drawn rows are range-partitioned, for their ranks.

Defined results: a null or wordless text has no features and weight 0; a null id is hashed like an empty one and comes
after all others where scores tie; rows with one id and score are drawn in the order in which they were written; an empty
target smooths to equal shares; an empty table gives an empty result.  Other columns of the input are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.llm.stage import numbered, ordered, stage

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
#: Probes of one counting job: it does the work of four plain halvings.
PROBES = 15
#: Cached features: so many, none longer than so many bytes (together less than 100 MB).
CACHE, CACHED_BYTES = 500_000, 48
#: Bytes that part words become blanks, A-Z become small: digits, letters and everything beyond ASCII are words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Lookup(dict):
    """A number for each feature (bytes), by its bucket; remembered for short features."""

    def __init__(self, by_bucket: list[int]):
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        x = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        if len(feature) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[feature] = x
        return x


def features(text: str | None, lo: int, hi: int) -> tuple[int, list[bytes]]:
    """Number of words, and the features, of a text."""
    words = (text or "").encode().translate(WORDS).split()
    if lo == hi == 1:
        return len(words), words
    return len(words), [b" ".join(words[i : i + k]) for k in range(lo, hi + 1) for i in range(len(words) - k + 1)]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, lo: int = 1, hi: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, total = Lookup(list(range(buckets))), np.zeros(buckets, np.int64)
        held: Counter[bytes] = Counter()

        def add():
            np.add.at(total, [known[f] for f in held], list(held.values()))
            held.clear()

        for batch in batches:
            for t in batch.column(0):
                held.update(features(t.as_py(), lo, hi)[1])
                if len(held) >= CACHE:
                    add()
        if held:
            add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t+1) / (T+M)) / ((s+1) / (S+M)))) of each of the M buckets."""
    m, s_all, t_all = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s_all / ((float(source[i]) + 1) * t_all))) for i in range(m)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 g) of a standard Gumbel number g that the seed and the key determine."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, gain: np.ndarray, lo: int = 1, hi: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` by looking features up in the array of gains."""
    by_bucket = gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]):
        known = Lookup(by_bucket)
        for batch in batches:
            n, size, mean = [], [], []
            for t in batch.column(1):
                words, found = features(t.as_py(), lo, hi)
                n.append(words)
                size.append(len(found))
                mean.append(sum(map(known.__getitem__, found)) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, size, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def least_with(rows: DataFrame, value: Column, wanted: int, low: int, high: int) -> tuple[int, int]:
    """The least v in low..high with at least ``wanted`` rows at or below it, and how many rows lie below v.

    ``high`` must have as many.  Each job counts the rows at or below some probes and narrows the range to one gap.
    """
    before = 0
    while low < high:
        probes = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)} | {low})
        probes = [p for p in probes if p < high]
        found = rows.agg(*[F.count_if(value <= F.lit(p)).alias(f"p{i}") for i, p in enumerate(probes)]).first()
        for p, n in zip(probes, found, strict=True):
            if n >= wanted:
                high = p
                break
            low, before = p + 1, n
    return low, before


def drawn(scored: DataFrame, eligible: Column, wanted: int) -> Column:
    """Whether a written row (doc_id, score, _row) is among the ``wanted`` highest scores; ties to smaller ids, then rows."""
    rows = scored.where(eligible)
    ends = rows.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    if wanted <= 0 or ends["a"] is None:
        return F.lit(False)
    least, above = least_with(rows, -F.col("score"), wanted, -ends["b"], -ends["a"])
    cut, left = -least, wanted - above
    tied = rows.where(F.col("score") == cut)
    ends = tied.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("doc_id").alias("n")).first()
    if left > ends["n"]:  # all ids, and some of the rows without one
        last, left = None, left - ends["n"]
        same = F.col("doc_id").isNull()
    else:
        last, before = least_with(tied, F.col("doc_id"), left, ends["a"], ends["b"])
        left -= before
        same = F.col("doc_id") == F.lit(last)
    ends = tied.where(same).agg(F.min("_row").alias("a"), F.max("_row").alias("b")).first()
    row, _ = least_with(tied.where(same), F.col("_row"), left, ends["a"], ends["b"])
    earlier = F.col("doc_id").isNotNull() if last is None else F.coalesce(F.col("doc_id") < F.lit(last), F.lit(False))
    at_cut = (F.col("score") == cut) & (earlier | (F.coalesce(same, F.lit(False)) & (F.col("_row") <= row)))
    return eligible & ((F.col("score") > cut) | at_cut)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, lo: int = 1, hi: int = 1, buckets: int = BUCKETS, gain_of: Callable[[np.ndarray, np.ndarray], np.ndarray] = gains) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` from 1 for the drawn ones, else null.

    Drawn are ``percent`` of the documents with at least ``min_words`` words.
    """
    gain = gain_of(bucket_counts(docs, buckets, lo, hi), bucket_counts(target, buckets, lo, hi))
    scored = weights(docs, gain, lo, hi).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored.withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    eligible = F.col("n_words") >= min_words
    wanted = percent * scored.where(eligible).count() // 100
    scored = scored.withColumn("_drawn", drawn(scored, eligible, wanted))
    top = scored.where("_drawn").withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    ranked = numbered(ordered(top, ["_down", "_none", "doc_id", "_row"], "resample-drawn"))
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~F.col("_drawn")).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionAll(ranked.select(*out, (F.col("_rank") + 1).alias("rank")))
