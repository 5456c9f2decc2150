"""Importance resampling against its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesift.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(docs, target, percent, min_words, lo=1, hi=1, m=10_000, seed=2024):
    def buckets(text):
        w = WORD.findall((text or "").translate(SMALL))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % m for k in range(lo, hi + 1) for i in range(len(w) - k + 1)]

    found = [(k, *buckets(t)) for k, t in docs]
    s, t = Counter(x for *_, f in found for x in f), Counter(x for text in target for x in buckets(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for k, n, f in found:
        gain = [math.floor(1000 * math.log((t[x] + 1) * (s_all + m) / ((s[x] + 1) * (t_all + m)))) for x in f]
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append((k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[: len(able) * percent // 100]


def key(r):
    return r[0] is None, r[0] or 0, *r[1:4], r[4] or 0


def check(out, rows, top):
    got = [tuple(r) for r in out.collect()]
    assert sorted((r[:4] for r in got), key=lambda r: key((*r, 0))) == sorted(((r[0], *r[2:]) for r in rows), key=lambda r: key((*r, 0)))
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(top) + 1))
    assert [(r[0], r[3]) for r in ranked] == [(r[0], r[4]) for r in top]


@pytest.mark.parametrize("percent", [10, 50, 100, 0])
def test_table(spark, percent):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows, top = model([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()], percent, 20)
    check(resample.resample(docs, bench, percent), rows, top)


@pytest.mark.parametrize("lo,hi,m", [(1, 1, 10_000), (1, 2, 500), (2, 3, 7)])
def test_hard_rows_and_longer_runs(spark, hard, hard_rows, lo, hi, m):
    docs = hard.withColumnRenamed("source", "score").withColumnRenamed("n_chars", "rank").withColumnRenamed("lang", "_row")
    target = spark.createDataFrame([("w1 w2 W3 changed", 1), (None, 2), ("", 3)], "text string, weight int")
    rows, top = model([(k, t) for k, t, *_ in hard_rows], ["w1 w2 W3 changed"], 60, 5, lo, hi, m)
    check(resample.resample(docs, target, 60, 5, lo=lo, hi=hi, buckets=m), rows, top)


def test_empty_tables(spark, none, hard):
    bench = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(none, bench).count() == 0
    assert resample.resample(hard, bench.limit(0), percent=100, min_words=0).where("rank is null").count() == 0


def test_cached_features_are_bounded():
    known = resample.Lookup(list(range(10)))
    for i in range(resample.CACHE + 10):
        assert known[b"%d" % i] == zlib.crc32(b"%d" % i) % 10
    assert len(known) <= resample.CACHE and known[b"x" * 1000] == zlib.crc32(b"x" * 1000) % 10 and b"x" * 1000 not in known


@pytest.mark.parametrize("wanted", [0, 1, 3, 7, 20, 33, 40, 55, 59, 60])
def test_ties_at_the_cut(spark, wanted):
    """Scores that many rows share, repeated and null ids: the rows in order of score, id (nulls last), row."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else int(rng.integers(-5, 8)), int(rng.integers(0, 3)), i, True) for i in range(60)] + [(1, 99, 99, False)]
    df = spark.createDataFrame(rows, "doc_id long, score long, _row long, able boolean")
    order = sorted((r for r in rows if r[3]), key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    got = {r["_row"] for r in df.where(resample.drawn(df, F.col("able"), wanted)).collect()}
    assert got == {r[2] for r in order[:wanted]}
