"""N-best segmentation: forward Viterbi scores as exact heuristics of a backward A* search over the piece lattice.

Each distinct pre-token gets its lattice of pieces and, from the left, the best score to every position.  The search
starts at the right end; a partial path's priority is its own score plus the best score of what is still in front,
which is exact, so complete paths leave the queue from the best on.  Since pre-tokens are independent, the n best
segmentations of a text change it only in the pre-tokens whose second-best costs least: n - 1 of them at most.

Each partial path stands for complete ones of its own, the best of which is its priority; so of all waiting paths only as
many as are still wanted are kept, the best ones.  What is found for a pre-token (scores, ids, whether its pieces spell it)
is kept by the worker from task to task, up to a bound in bytes.  Ties go to the path that is nearer to the start, then to the one found first; the
order is the same in every run.  Defined results: a null or empty text
has the one empty segmentation; fewer than n segmentations give a shorter list; repeated rows are encoded alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.llm.packing import text_batches
from linesift.llm.unigram import MARK, Unigram, marked, pretokens, unigram

N = 3
#: Characters encoded together; bytes of one generation of known pre-tokens, and of an entry's own objects.
RUN_CHARS, GENERATION, ENTRY = 2_000_000, 128 << 20, 400
#: Characters that a table of beginnings is kept by, and its entries at most.
HEAD, HEADS = 3, 60_000
Segmentation = tuple[float, tuple[int, ...]]


def _starts(text: str, model: Unigram) -> tuple[list[tuple[int, float, bytes]], dict | None]:
    """Pieces (length, score, ids) that the text begins with, or its first character's bytes; and the steps that go on behind it."""
    found, node, size = [], model.steps, 0
    for c in text:
        if (step := node.get(c)) is None:
            node = None
            break
        node, s, ids = step
        size += 1
        if ids is not None:
            found.append((size, s, ids))
    if not found or found[0][0] > 1:
        raw = model.fallback(text[0])
        found.append((1, len(raw) * model.byte_score, np.array(raw, "<u4").tobytes()))
    return found, node or None


def lattice(word: str, model: Unigram) -> tuple[list[list[tuple[int, float, bytes]]], list[float], bool]:
    """Arcs by end position (start, score, ids), the best score from the start to each position, and whether all arcs are pieces.

    What begins with the same few characters is looked up once, as long as the table of them is small.
    """
    size, whole, known = len(word), True, model.starts
    arcs: list[list] = [[] for _ in range(size + 1)]
    best = [0.0] + [-math.inf] * size
    for start in range(size):  # all arcs that end here are known
        before, head = best[start], word[start : start + HEAD]
        if (entry := known.get(head)) is None:
            if len(known) >= HEADS:
                known.clear()
            entry = known[head] = _starts(head, model)
        for length, s, ids in entry[0]:
            arcs[start + length].append((start, s, ids))
            if before + s > best[start + length]:
                best[start + length] = before + s
        if s <= model.byte_score:  # the last one is the character's bytes
            whole = False
        if (node := entry[1]) is not None:
            for at in range(start + HEAD, size):
                if (step := node.get(word[at])) is None:
                    break
                node, s, ids = step
                if ids is not None:
                    arcs[at + 1].append((start, s, ids))
                    if before + s > best[at + 1]:
                        best[at + 1] = before + s
    return arcs, best, whole


def _search(arcs: list[list], best: list[float], n: int) -> list[tuple[float, bytes]]:
    # (negated priority, position, order of entry, score so far, pieces from here to the end as a linked list), sorted
    waiting: list[tuple] = [(-best[-1], len(arcs) - 1, 0, 0.0, None)]
    entered = held = 0
    room = n
    found: list[tuple[float, bytes]] = []
    while True:
        _, at, _, s, rest = waiting.pop(0)
        if at == 0:
            parts = []
            while rest is not None:
                piece, rest = rest
                parts.append(piece)
            found.append((s, b"".join(parts)))
            room -= 1
            if not (waiting and room):
                return found
            continue
        held = len(waiting)
        last = waiting[-1][0] if held >= room else math.inf
        for start, t, piece in arcs[at]:
            priority = -(best[start] + s + t)
            if priority > last or priority == last and held >= room and start >= waiting[-1][1]:
                continue
            entered += 1
            insort(waiting, (priority, start, entered, s + t, (piece, rest)))
            if held >= room:
                waiting.pop()
            else:
                held += 1
            if held >= room:
                last = waiting[-1][0]


def n_best(word: str, model: Unigram, n: int = N) -> list[Segmentation]:
    """The n best segmentations of a pre-token."""
    arcs, best, _ = lattice(word, model)
    return [(s, tuple(np.frombuffer(ids, "<u4").tolist())) for s, ids in _search(arcs, best, n)]


class Known:
    """A pre-token's n best: score, ids as bytes, their number; what the second best loses; whether the best spells it."""

    __slots__ = ("choices", "loss", "spelt")

    def __init__(self, word: str, model: Unigram, n: int):
        arcs, best, whole = lattice(word, model)
        found = _search(arcs, best, n)
        self.choices = [(s, ids, len(ids) // 4) for s, ids in found]
        self.loss = found[0][0] - found[1][0] if len(found) > 1 else None
        # Decoding drops the first blank: a mark put in front takes its place.  Pieces found in a word spell it.
        self.spelt = whole and model.mark_first or model.decode([model.first_mark, *np.frombuffer(found[0][1], "<u4").tolist()]) == word.replace(MARK, " ")

    def size(self, word: str) -> int:
        return ENTRY + 2 * len(word) + sum(120 + len(ids) for _, ids, _ in self.choices)


class Segmenter:
    """The worker's pre-tokens, in two generations bounded by their bytes."""

    def __init__(self, path: str, n: int):
        self.model, self.n = unigram(path), n
        self.new: dict[str, Known] = {}
        self.old: dict[str, Known] = {}
        self.held = 0

    def look_up(self, texts: list[list[str]]) -> dict[str, Known]:
        """A table that holds all words of the texts."""
        if self.held > GENERATION:
            self.new, self.old, self.held = {}, self.new, 0
        for w in set(itertools.filterfalse(self.new.__contains__, itertools.chain.from_iterable(texts))):
            found = self.old.get(w) or Known(w, self.model, self.n)
            self.new[w] = found
            self.held += found.size(w)
        return self.new


@lru_cache(maxsize=2)
def segmenter(path: str, n: int) -> Segmenter:
    return Segmenter(path, n)


def combine(words: list[Known], n: int = N) -> list[tuple[float, dict[int, int]]]:
    """The n best of a text: loss against the best, and which pre-tokens take which other segmentation.

    The cheapest changes are taken in one after the other, and only the n best sums are carried on.
    """
    cheapest = [i for _, i in heapq.nsmallest(n - 1, ((w.loss, i) for i, w in enumerate(words) if w.loss is not None))]
    best: list[tuple] = [(0.0, 0, ())]
    for i in cheapest:
        top, _, size = words[i].choices[0]
        options = [(top - s, k - size, ((i, j),) if j else ()) for j, (s, _, k) in enumerate(words[i].choices)]
        best = heapq.nsmallest(n, ((a + x, b + y, c + z) for a, b, c in best for x, y, z in options))
    return [(loss, dict(changed)) for loss, _, changed in best]


def encode_n_best(docs: DataFrame, path: str, n: int = N, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the n best encodings, each as score, number of ids and checksum of the ids, and the decoded best.

    ``doc_id, n_pieces, scores, lengths, ids_crc32 (arrays, best first), decoded_crc32, round_trip``.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        worker = segmenter(path, n)
        for batch in batches:
            for lo, texts in text_batches(batch, "text", RUN_CHARS):
                cut = [pretokens(marked(t)) for t in texts]
                known = worker.look_up(cut)
                rows = [_encoded(t, list(map(known.__getitem__, words)), worker.model, n) for t, words in zip(texts, cut, strict=True)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
                names = ["doc_id", "n_pieces", "scores", "lengths", "ids_crc32", "decoded_crc32", "round_trip"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = "doc_id long, n_pieces long, scores array<double>, lengths array<long>, ids_crc32 array<long>, decoded_crc32 long, round_trip boolean"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _encoded(text: str, words: list[Known], model: Unigram, n: int) -> tuple:
    best = sum(w.choices[0][0] for w in words)
    raw = [w.choices[0][1] for w in words]
    scores, lengths, crc = [], [], []
    for loss, changed in combine(words, n):
        parts = raw
        if changed:
            parts = raw.copy()
            for i, j in changed.items():
                parts[i] = words[i].choices[j][1]
        ids = b"".join(parts)
        scores.append(best - loss)
        lengths.append(len(ids) // 4)
        crc.append(zlib.crc32(ids))
    # Pieces that spell every pre-token spell the text; a mark in the text itself is read as a blank.
    if MARK not in text and all(w.spelt for w in words):
        decoded = text
    else:
        decoded = model.decode(np.frombuffer(b"".join(raw), "<u4").tolist())
    return lengths[0], scores, lengths, crc, zlib.crc32(decoded.encode()), decoded == text
