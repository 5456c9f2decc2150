"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike letters and digits.

Folding lower-cases, drops zero-width characters, maps look-alike letters and accents-free digit substitutions to the
plain letter and turns everything between words into one blank, so that an entry `` stem`` matches where a word
starts with the stem and `` word `` where a whole word stands.

Training (Spark, at most about ``LEARN_ROWS`` labelled rows): in how many toxic and other documents each word and each word start occurs,
log-odds as weights, entries kept by support and precision, starts before words.  Words in front of and behind a match
that only ever occur in non-toxic documents become exception phrases, whose matches don't count.  A document's rate is
the sum of its matches' weights by word; a logistic curve over log(1 + rate), fitted on at most ``FIT_ROWS`` training
rows, gives the score.

Defined results: a null or empty text has no match and gets the score of rate 0; repeated rows are scored alike; with
no label of one kind the lexicon is empty and every score is the share of toxic rows (0 without rows); an empty table
gives an empty result.  Columns of the input whose names clash with the result's are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.llm.stage import stage

#: Look-alike letters (Cyrillic, Greek, full-width handled by rule below) and digits or signs for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
HIDDEN = "­​‌‍⁠﻿"
#: Word starts of these lengths are candidates beside whole words.
STEMS = range(4, 9)
#: An entry needs this share of the toxic documents (and this many), and this many times the other documents' share.
SUPPORT, LEAST, RATIO = 0.01, 5, 25.0
#: Most entries, exception phrases, and rows that the curve is fitted on.
ENTRIES, PHRASES, FIT_ROWS = 2000, 2000, 50_000
#: Labelled rows that are learned from: all up to this many, beyond that a sample of about this size by hash of the id.
LEARN_ROWS = 100_000
WORD = re.compile(r"[^\W_]+")

_FOLD = {ord(k): v for k, v in {**LOOKALIKES, **DIGITS}.items()} | {ord(c): None for c in HIDDEN} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_BEYOND_ASCII = {k: v for k, v in _FOLD.items() if k > 127}


def fold(text: str | None) -> str:
    """Folded words between single blanks, one in front and one behind.

    A word of digits only stays as it is; elsewhere digits stand for letters.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_BEYOND_ASCII)
    words = (w if w.isalpha() else _letters(w) for w in re.findall(r"[^\W_]+(?:[@$][^\W_]+)*", text))
    return f" {' '.join(words)} "


_ASCII = {ord(k): v for k, v in DIGITS.items()}


def _letters(w: str) -> str:
    return w if w.isdigit() else w.translate(_ASCII)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float] = (0.0, 0.0)  # slope, intercept


class Matcher:
    def __init__(self, lex: Lexicon):
        self.lex, self.automaton, self.phrases = lex, None, None
        if lex.weights:
            self.automaton = ahocorasick.Automaton()
            for entry, w in lex.weights.items():
                self.automaton.add_word(entry, (len(entry), w))
            self.automaton.make_automaton()
        if lex.phrases:
            self.phrases = ahocorasick.Automaton()
            for p in lex.phrases:
                self.phrases.add_word(f" {p} ", len(p) + 2)
            self.phrases.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight; matches inside an exception phrase are left out."""
        if not self.automaton:
            return []
        hits = [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton.iter(folded)]
        if hits and self.phrases:
            spared = sorted((end + 1 - n, end + 1) for end, n in self.phrases.iter(folded))
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            # Of the phrases that begin no later than a match, the one that reaches furthest decides.
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]
        return hits

    def rate(self, text: str | None) -> float:
        folded = fold(text)
        hits = self.matches(folded)
        if not hits:
            return 0.0
        return sum(w for _, _, w in hits) / max(1, folded.count(" ") - 1)

    def score(self, rate: float) -> float:
        a, b = self.lex.curve
        return float(1 / (1 + np.exp(-np.clip(a * np.log1p(1000 * rate) + b, -60, 60))))


@lru_cache(maxsize=4)
def _matcher(key: tuple) -> Matcher:
    return Matcher(Lexicon(dict(key[0]), key[1], key[2]))


def matcher(lex: Lexicon) -> Matcher:
    return _matcher((tuple(lex.weights.items()), lex.phrases, lex.curve))


def training(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> DataFrame:
    """Texts and labels of about ``limit`` labelled rows, by hash of the id, that may be learned from (all rows up to there).

    The chosen ids are bounded, so they are broadcast: no text is shuffled.  The result is staged, as it is read four times.
    """
    labels = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    n, whole = labels.count(), 1 << 40
    if n > limit:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < whole * limit // n)
    chosen = F.broadcast(labels.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", (F.col("_toxic") > 0).cast("int").alias("toxic"))
    return stage(rows, "toxicity-training")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0: kept for measuring, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def candidate_counts(rows: DataFrame) -> DataFrame:
    """``entry, toxic, other``: documents of each kind with a word (`` word ``) or a word start (`` stem``)."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["entry", "toxic", "other"])
            held.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(fold(text.as_py()).split())
                found = {f" {w} " for w in words}
                for k in STEMS:
                    found.update(" " + w[:k] for w in words if len(w) > k)
                for e in found:
                    held.setdefault(e, [0, 0])[1 - toxic] += 1
                if len(held) > 400_000:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exception phrases and curve from the labelled rows outside the held-out fold."""
    rows = training(docs, labels)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Lexicon(curve=(0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("other") + 0.5) / (n0 + 1.0))
    good = candidate_counts(rows).where((F.col("toxic") >= max(LEAST, SUPPORT * n1)) & (F.col("toxic") / n1 >= RATIO * F.col("other") / n0))
    top = good.withColumn("w", odds).orderBy(F.desc("w"), "entry").limit(ENTRIES).collect()
    weights: dict[str, float] = {}
    # A start stands for the longer starts and words that it opens.
    for r in sorted(top, key=lambda r: (len(r["entry"].strip()), r["entry"].endswith(" "), r["entry"])):
        e = r["entry"]
        if not any(e[:k] in weights for k in range(2, len(e))):
            weights[e] = float(r["w"])
    found = exception_phrases(rows, Lexicon(weights)) if weights else []
    lex = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *found])))
    lex.curve = fit_curve(rows, lex, n0 + n1)
    return lex


def exception_phrases(rows: DataFrame, lex: Lexicon) -> list[str]:
    """Two-word phrases around a match that occur in LEAST or more non-toxic documents and in no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = matcher(lex)
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                folded = fold(text.as_py())
                seen = set()
                for start, end, _ in m.matches(folded):
                    stop = folded.index(" ", max(end - 1, start + 1))
                    word = folded[start + 1 : stop]
                    ends = folded.find(" ", stop + 1)
                    before, after = folded[folded.rfind(" ", 0, start) + 1 : start], folded[stop + 1 : ends if ends >= 0 else None]
                    seen |= {f"{before} {word}"} if before else set()
                    seen |= {f"{word} {after}"} if after else set()
                out += [(p, toxic) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int64())], names=["phrase", "toxic"])

    found = rows.mapInArrow(run, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    return [r["phrase"] for r in found.where((F.col("t") == 0) & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "phrase").limit(PHRASES).collect()]


def fit_curve(rows: DataFrame, lex: Lexicon, n: int) -> tuple[float, float]:
    """Logistic regression on log(1 + 1000 rate), by Newton steps with a small ridge."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = matcher(lex)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.rate(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1).cast(pa.int64())], names=["rate", "toxic"])

    # A bounded sample: all rows up to FIT_ROWS, beyond that every k-th hash.
    part = max(1, -(-n // FIT_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0) if part > 1 else rows
    got = sample.mapInArrow(run, "rate double, toxic long").groupBy("rate", "toxic").count().collect()
    x = np.log1p(1000 * np.array([r["rate"] for r in got]))
    y, k = np.array([r["toxic"] for r in got], float), np.array([r["count"] for r in got], float)
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -60, 60)))
        g = design.T @ (k * (p - y)) + 0.5 * theta
        h = (design * (k * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``: one pass over the texts, no shuffle."""
    docs = docs.drop("score", "predicted")
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        m = matcher(lex)
        for batch in batches:
            s = [m.score(m.rate(t.as_py())) for t in batch.column(kept.index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(run, schema)
