"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame functions only).

Row numbers 0..N-1 follow the key order.  A keyed Feistel network over the pairs (left < a, right < b) permutes
0..a*b-1; a value of N or more is sent through again until it falls below N (cycle walking).  The permuted number p
gives shard ``p % shards`` and slot ``p // shards``: shard sizes differ by one at most, slots have no gaps, and row and
place follow from each other by arithmetic alone (:func:`place_of_row`, :func:`row_of_place`).

Defined results: a null key sorts first and is a row like any other, equal keys are ordered by size and checksum of
the text, a null text has size 1 and no checksum, an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.llm.stage import numbered, ordered

#: Prime modulus of the round function, and its round keys (fixed values: they define the shuffle).
PRIME = 2147483647
ROUND_KEYS = (1103515245, 1540483477, 668265263, 374761393)
#: Side lengths tried around the square root of N, none below half of it: both halves need room to mix.
REACH = 2000


def domain(n: int) -> tuple[int, int]:
    """Sides a, b with a*b >= n and the fewest values from n on, the smaller a first."""
    root = max(1, math.isqrt(n))
    return min(((a, max(1, -(-n // a))) for a in range(max(1, root - REACH, -(-root // 2)), min(root + REACH, 2 * root) + 1)), key=lambda s: (s[0] * s[1] - n, s[0]))


def _mixed(x: int, key: int) -> int:
    y = (x + key) % PRIME
    return y * (y + key) % PRIME


def permute(x: int, n: int) -> int:
    """The permuted row number, walked into 0..n-1."""
    a, b = domain(n)
    while True:
        left, right = divmod(x, b)
        for i in range(0, len(ROUND_KEYS), 2):
            left = (left + _mixed(right, ROUND_KEYS[i])) % a
            right = (right + _mixed(left, ROUND_KEYS[i + 1])) % b
        x = left * b + right
        if x < n:
            return x


def invert(p: int, n: int) -> int:
    """The row number whose permuted number is ``p``."""
    a, b = domain(n)
    while True:
        left, right = divmod(p, b)
        for i in range(len(ROUND_KEYS) - 2, -1, -2):
            right = (right - _mixed(left, ROUND_KEYS[i + 1])) % b
            left = (left - _mixed(right, ROUND_KEYS[i])) % a
        p = left * b + right
        if p < n:
            return p


def place_of_row(row: int, n: int, shards: int) -> tuple[int, int]:
    p = permute(row, n)
    return p % shards, p // shards


def row_of_place(shard: int, slot: int, n: int, shards: int) -> int:
    return invert(slot * shards + shard, n)


def _mixed_col(x: Column, key: int) -> Column:
    y = (x + F.lit(key)) % F.lit(PRIME)
    return y * (y + F.lit(key)) % F.lit(PRIME)


def _network(x: Column, a: int, b: int) -> Column:
    left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
    for i in range(0, len(ROUND_KEYS), 2):
        left = (left + _mixed_col(right, ROUND_KEYS[i])) % F.lit(a)
        right = (right + _mixed_col(left, ROUND_KEYS[i + 1])) % F.lit(b)
    return left * F.lit(b) + right


def permuted(df: DataFrame, row: str, n: int, out: str = "_p") -> DataFrame:
    """``out``: the permuted number of column ``row`` in 0..n-1.

    A walk leaves the a*b - n values above at most one after the other, so that many steps (0 for most tables, a few
    at worst) always suffice; steps after the walk has ended cost nothing.
    """
    a, b = domain(n)
    df = df.withColumn("_l", F.call_function("div", F.col(row), F.lit(b))).withColumn("_r", F.col(row) % F.lit(b))
    for i in range(0, len(ROUND_KEYS), 2):
        df = df.withColumn("_l", (F.col("_l") + _mixed_col(F.col("_r"), ROUND_KEYS[i])) % F.lit(a))
        df = df.withColumn("_r", (F.col("_r") + _mixed_col(F.col("_l"), ROUND_KEYS[i + 1])) % F.lit(b))
    p = F.col("_l") * F.lit(b) + F.col("_r")
    if steps := a * b - n:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, lambda x, _: F.when(x < F.lit(n), x).otherwise(_network(x, a, b)))
        p = F.when(p < F.lit(n), p).otherwise(walk)
    return df.withColumn(out, p.cast("long")).drop("_l", "_r")


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for each row, under the law ``rows``.

    Only key, size and checksum travel: texts are read once and stay where they are.
    """
    data = F.col(text).cast("binary")
    slim = docs.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    staged = ordered(slim, [key, "size", "text_crc32"], "shard-rows")
    n = staged.count()
    out = permuted(numbered(staged), "_rank", n)
    return out.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("_p"), F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_rank").alias("row"),
    )
