"""Quality rules: base counts of a text, and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of character n-grams (order 5), one for each value of ``lang``.
Characters rather than words keep the table small against the corpus and give new words a fair probability.
Spark counts the n-grams of all texts and derives continuation counts, discounts, context sums and interpolated
probabilities as joins and aggregates.  Each distinct n-gram that is to be judged is looked up in the model once, order by
order, by joins.  The finished values are stored in sorted hash arrays (64-bit keys, 32-bit log values) that are searched
by bisection; they are sent to the executors while they take at most ``BROADCAST_MODEL_BYTES``.  More of them are joined to
the n-grams of the documents by hash.  Either way a document is judged by the same values and bands.

A document is rejected where its mean log perplexity leaves its language's band: the median plus and minus a multiple
of the distance from the median to the quartiles, over all documents of the language that pass the base rules.  The
query and the pipeline judge out of sample: texts are halved by their crc32, so that copies of a text share a half, and
each half is scored with the model of the other and has its own band.

Defined results: a null text is an empty one and a null language is the language ''; texts without an n-gram have no
perplexity and lie in no band's way; repeated rows are judged alike; a half without another one has no model, so all its
n-grams are equally unlikely and its band rejects nothing; an empty table gives an empty result.  Columns of the input whose names clash with the result's are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.llm import textblock as T
from linesift.llm.stage import stage

ORDER = 5
BROADCAST_MODEL_BYTES = 96 << 20
#: Base rules (given): fewest words, and the most percent of words in repeated windows of so many words.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Band: so many quartile distances below and above the median of log perplexity, none taken below LEAST_SPREAD; wider
#: by sqrt(1 + SHORT / n-grams) for short texts, whose mean varies more.
LOWER, UPPER, SHORT, LEAST_SPREAD = 4.0, 4.0, 2000, 0.01
#: Rows of per-language sums that are sent to the executors at most.
FEW_LANGUAGES = 10_000
#: Distinct n-grams gathered in a task before they are merged, and rows of them handed on together.
GATHER, HANDED_ON = 800_000, 100_000
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, log_ppl double"


def _is_symbol() -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(SYMBOLS, np.uint8)] = True
    return out


def base_counts(b: T.Block) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    starts, ends, doc = T.word_spans(b)
    n, size = b.n, len(b.data)

    def between(flags: np.ndarray) -> np.ndarray:
        run = np.zeros(size + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[b.offs[1:]] - run[b.offs[:-1]]

    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": between(((b.data & 0xC0) != 0x80) & ~T._WS[b.data]), "n_symbols": between(_is_symbol()[b.data])}

    # Lines: cut at line ends and document ends; those with a word, equal to an earlier one of the same document.
    cut = np.union1d(np.flatnonzero(b.data == 10) + 1, b.offs)
    lo, hi = cut[:-1], cut[1:]
    hi = hi - ((hi > lo) & (b.data[np.maximum(hi - 1, 0)] == 10)) if size else hi
    words = np.zeros(size + 1, np.int64)
    np.cumsum(~T._WS[b.data], out=words[1:])
    full = words[hi] > words[lo]
    lo, hi = lo[full], hi[full]
    owner = np.searchsorted(b.offs, lo, "right") - 1
    out["n_dup_lines"] = np.bincount(owner[_repeated(T.span_hash(b.data, lo, hi), owner)[1]], minlength=n) if len(lo) else np.zeros(n, np.int64)

    # Words covered by windows that occur twice or more.
    win, at = T.windows(T.span_hash(b.data, starts, ends), doc, WINDOW)
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(win):
        twice = at[_repeated(win, doc[at])[0]]
        cover[:-1] += np.bincount(twice, minlength=len(starts))
        cover -= np.bincount(twice + WINDOW, minlength=len(starts) + 1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _repeated(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags by position: this value occurs again in its document; it has occurred before there."""
    key = T.mix(h + owner.astype(np.uint64) * np.uint64(T.STEP))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before


def characters(b: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points (white space as blanks) and the offsets of the documents in them."""
    cps = np.frombuffer(b.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    cps[(cps >= 9) & (cps <= 13)] = 32
    run = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=run[1:])
    return cps, run[b.offs]


def salt(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode())


def gram_hash(grams: np.ndarray, salts: np.ndarray | int, k: int) -> np.ndarray:
    """Hash of n-grams given as ``k`` arrays of code points, under a language's salt."""
    h = np.zeros(len(grams[0]), np.uint64) + np.asarray(salts, np.uint64) * np.uint64(T.STEP)
    for x in grams:
        h = h * np.uint64(T.BASE) + x
    return T.mix(h + np.uint64(k))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a position of each, how often it occurs, and each position's index among them."""
    order = np.argsort(h)
    ordered = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    index = np.empty(len(h), np.int64)
    index[order] = np.cumsum(new) - 1
    return ordered[first], order[first], np.diff(first, append=len(h)), index


def positions(offs: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First characters of the k-grams inside documents, and their documents."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return at, doc[at]


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all texts: counted in each task first, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        names: dict[int, str] = {}
        size = 0

        def merged():
            h, n, s, g = (np.concatenate(x) for x in zip(*held, strict=True))
            order_ = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[order_], prepend=~h[order_][:1]) != 0)
            at = order_[first]
            return h[at], np.add.reduceat(n[order_], first), s[at], g[at]

        for batch in batches:
            langs = [x or "" for x in batch.column(1).to_pylist()]
            for b in T.blocks(batch):
                cps, offs = characters(b)
                at, doc = positions(offs, order, len(cps))
                if not len(at):
                    continue
                names.update((salt(x), x) for x in set(langs[b.lo : b.hi]))
                salts = np.array([salt(x) for x in langs[b.lo : b.hi]], np.uint64)[doc]
                h = gram_hash([cps[at + j] for j in range(order)], salts, order)
                key, first, n, _ = distinct(h)
                held.append((key, n, salts[first], np.stack([cps[at[first] + j] for j in range(order)], axis=1)))
                size += len(key)
                if size > GATHER:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHER // 2:  # mostly distinct: hand them on
                        yield from _gram_rows(held[0], names, order)
                        held, size = [], 0
        if held:
            yield from _gram_rows(merged(), names, order)

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gram_rows(held: tuple, names: dict[int, str], order: int) -> Iterator[pa.RecordBatch]:
    _, counts, salts, grams = held
    for lo in range(0, len(counts), HANDED_ON):
        n, s, g = (x[lo : lo + HANDED_ON] for x in (counts, salts, grams))
        text = g.astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([names[int(x)] for x in s], pa.string()), pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, gram, logp)`` of all seen n-grams of each order k, and ``(lang, k, gram, logb)`` of contexts of k characters.

    Interpolated modified Kneser-Ney: the highest order uses counts, a lower one the number of distinct characters
    seen in front; three discounts for each order come from its counts of counts.
    """
    tables = {order: counts.select("lang", "gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        tables[k] = stage(tables[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("c")), f"grams-{k}")
    types = tables[1].groupBy("lang").agg((F.count("*") + F.lit(1)).alias("v"))
    # One row for each language: sent around while these are few, so that no language's n-grams meet in one task.
    small = F.broadcast if types.count() <= FEW_LANGUAGES else (lambda df: df)
    probs, backoffs, lower = [], [], None
    for k in range(1, order + 1):
        t = tables[k]
        of = lambda i: F.sum((F.col("c") == i).cast("double"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        rate = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")))).otherwise(F.lit(0.5))
        d = t.groupBy("lang").agg(of(1).alias("n1"), of(2).alias("n2"), of(3).alias("n3"), of(4).alias("n4")).select("lang", rate(1).alias("d1"), rate(2).alias("d2"), rate(3).alias("d3"))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(small(d), "lang").withColumn("cut", F.least(cut, F.col("c").cast("double"))).withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("free"))
        t = t.join(ctx, ["lang", "ctx"])
        if k == 1:
            t = t.join(small(types), "lang").withColumn("below", F.lit(1.0) / F.col("v"))
        else:
            t = t.withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})")).join(lower, ["lang", "suffix"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("free") / F.col("total") * F.col("below")
        t = stage(t.select("lang", "gram", p.alias("p")), f"probabilities-{k}")
        lower = t.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        probs.append(t.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp")))
        backoffs.append(ctx.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("gram"), F.log(F.greatest(F.col("free") / F.col("total"), F.lit(1e-9))).alias("logb")))
    union = lambda xs: __import__("functools").reduce(DataFrame.unionAll, xs)
    return union(probs), union(backoffs)


def hash_arrays(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit keys and 32-bit values of a model table.  Only called for tables of a checked size."""

    def run(batches):
        for batch in batches:
            grams = batch.column(2).to_pylist()
            keys = np.zeros(len(grams), np.uint64)
            ks = np.array(batch.column(1).to_pylist(), np.int64)
            salts = np.array([salt(x) for x in batch.column(0).to_pylist()], np.uint64)
            for k in np.unique(ks).tolist():
                at = np.flatnonzero(ks == k)
                cps = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), k)
                keys[at] = gram_hash(list(cps.T) if k else [np.zeros(len(at), np.uint32)], salts[at], k)
            order = np.argsort(keys)
            values = batch.column(3).to_numpy()[order].astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([keys[order].tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["keys", "values"])

    rows = table.select("lang", "k", "gram", value).mapInArrow(run, "keys binary, values binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    values = np.concatenate([np.frombuffer(r["values"], "<f4") for r in rows] or [np.zeros(0, "<f4")])
    order = np.argsort(keys)
    return keys[order], values[order]


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, values[at]


def log_probabilities(grams: list[np.ndarray], salts: np.ndarray, model, order: int = ORDER) -> np.ndarray:
    """log p of the last character given the others, backing off to shorter contexts where an n-gram is unseen."""
    pk, pv, bk, bv = model
    out = np.zeros(len(grams[0]))
    left = np.arange(len(out))
    for k in range(order, 0, -1):
        g = [x[left] for x in grams[order - k :]]
        seen, v = _look(pk, pv, gram_hash(g, salts[left], k))
        out[left[seen]] += v[seen]
        left = left[~seen]
        if not len(left):
            return out
        ctx = [x[left] for x in grams[order - k : -1]] or [np.zeros(len(left), np.uint32)]
        known, b = _look(bk, bv, gram_hash(ctx, salts[left], k - 1))
        out[left[known]] += b[known]
    out[left] += np.log(1e-5)  # a character that its language has never shown
    return out


def score(docs: DataFrame, model, order: int = ORDER, key: str = "lang") -> DataFrame:
    """``docs`` (with text and lang) and FEATURES, in one pass; ``model`` is a broadcast of arrays, or None: no perplexity.

    Column ``key`` names the part of the model that a document is scored with.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]
    docs = docs.drop(*names)
    kept = docs.columns

    def run(batches):
        for batch in batches:
            langs = [x or "" for x in batch.column(kept.index(key)).to_pylist()]
            found: dict[str, list[np.ndarray]] = {x: [] for x in names}
            for b in T.blocks(batch):
                for name, v in base_counts(b).items():
                    found[name].append(v)
                sums, n = np.zeros(b.n), np.zeros(b.n, np.int64)
                cps, offs = characters(b)
                at, doc = positions(offs, order, len(cps))
                if len(at):
                    n = np.bincount(doc, minlength=b.n)
                    if model is not None:
                        salts = np.array([salt(x) for x in langs[b.lo : b.hi]], np.uint64)[doc]
                        grams = [cps[at + j] for j in range(order)]
                        _, one, _, index = distinct(gram_hash(grams, salts, order))  # each n-gram of a block is looked up once
                        lp = log_probabilities([x[one] for x in grams], salts[one], model.value, order)[index]
                        sums = np.bincount(doc, weights=lp, minlength=b.n)
                found["n_grams"].append(n)
                found["log_ppl"].append(np.where((n > 0) & (model is not None), -sums / np.maximum(n, 1), np.nan))
            if batch.num_rows:
                cols = [np.concatenate(found[x]) for x in names]
                new = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.float64(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + FEATURES
    return docs.mapInArrow(run, schema)


def gram_values(grams: DataFrame, probs: DataFrame, backoffs: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, gram, logp`` of distinct n-grams (``key, lang, gram``) under the model of ``lang``, each looked up once.

    The value of an n-gram that the model lacks is its context's back-off and the value of the n-gram without its first
    character; so the distinct ends of the n-grams are valued from the shortest on.
    """
    lower = None
    for k in range(1, order + 1):
        # The n-grams themselves are distinct and keep their key; their ends are not.
        part = grams.select("lang", F.expr(f"substring(gram, {order - k + 1}, {k})").alias("gram")).distinct() if k < order else grams.select("key", "lang", "gram")
        part = part.withColumns({"ctx": F.expr(f"substring(gram, 1, {k - 1})"), "end": F.expr(f"substring(gram, 2, {k - 1})")})
        p = probs.where(F.col("k") == k).select("lang", "gram", "logp")
        b = backoffs.where(F.col("k") == k - 1).select("lang", F.col("gram").alias("ctx"), "logb")
        part = part.join(p, ["lang", "gram"], "left").join(b, ["lang", "ctx"], "left")
        if lower is not None:
            part = part.join(lower.select("lang", F.col("gram").alias("end"), F.col("logp").alias("below")), ["lang", "end"], "left")
        else:  # a character that its language has never shown
            part = part.withColumn("below", F.log(F.lit(1e-5)))
        value = F.coalesce("logp", F.coalesce("logb", F.lit(0.0)) + F.col("below")).alias("logp")
        if k < order:
            lower = stage(part.select("lang", "gram", value), f"values-{k}")
    return part.select("key", "gram", value)


def hashed_values(values: DataFrame, order: int = ORDER) -> DataFrame:
    """``h, v``: hash of key and n-gram, and its value in 32 bits, of :func:`gram_values`; staged."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            salts = np.array([salt(x) for x in batch.column(0).to_pylist()], np.uint64)
            cps = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
            h = gram_hash(list(cps.T), salts, order)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(batch.column(2).to_numpy().astype("<f4"))], names=["h", "v"])

    return stage(values.mapInArrow(run, "h long, v float"), "ngram-values")


def value_arrays(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hash arrays of :func:`hashed_values`.  Only called for tables of a checked size."""
    found = hashed.toArrow()
    keys, values = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def score_by_values(docs: DataFrame, hashed: DataFrame, order: int = ORDER, key: str = "lang") -> DataFrame:
    """``_id, log_ppl`` of the rows of ``docs`` (``_id, text`` and ``key``): their distinct n-grams joined to the values."""
    docs = docs.select("_id", "text", F.col(key).alias("key"))

    def run(batches):
        for batch in batches:
            keys = [x or "" for x in batch.column(2).to_pylist()]
            ids = batch.column(0).to_numpy()
            for b in T.blocks(batch):
                cps, offs = characters(b)
                at, doc = positions(offs, order, len(cps))
                if not len(at):
                    continue
                h = gram_hash([cps[at + j] for j in range(order)], np.array([salt(x) for x in keys[b.lo : b.hi]], np.uint64)[doc], order)
                by = np.lexsort((h, doc))
                h, doc = h[by], doc[by]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[b.lo : b.hi][doc[first]]), pa.array(h[first].view(np.int64)), pa.array(np.diff(first, append=len(h)))], names=["_id", "h", "n"])

    rows = docs.mapInArrow(run, "_id long, h long, n long")
    return rows.join(hashed, "h").groupBy("_id").agg((-F.sum(F.col("v").cast("double") * F.col("n")) / F.sum("n")).alias("log_ppl"))


def score_by_joins(docs: DataFrame, probs: DataFrame, backoffs: DataFrame, order: int = ORDER) -> DataFrame:
    """``_id, log_ppl`` of the rows of ``docs`` (``_id, text, lang``) under any model, without sending it around."""
    grams = count_ngrams(docs, order).select(F.col("lang").alias("key"), "lang", "gram")
    return score_by_values(docs, hashed_values(gram_values(grams, probs, backoffs, order), order), order)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(scored: DataFrame, lower: float = LOWER, upper: float = UPPER, key: str = "lang") -> DataFrame:
    """``scored`` with ``base_failed``, the band of its ``key``, and ``kept``.  ``scored`` is read twice: stage it."""
    scored = scored.drop("base_failed", "kept", "band_low", "band_high").withColumn("base_failed", base_failed()).withColumn("_lang", F.coalesce(key, F.lit("")))
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000)
    bands = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("_lang").agg(q.alias("q"))
    spread = lambda a, b: F.greatest(F.col("q")[a] - F.col("q")[b], F.lit(LEAST_SPREAD))
    bands = bands.select("_lang", F.col("q")[1].alias("_mid"), (lower * spread(1, 0)).alias("_down"), (upper * spread(2, 1)).alias("_up"))
    bands = stage(bands, "quality-bands")
    if bands.count() <= FEW_LANGUAGES:  # so that no language's documents meet in one task
        bands = F.broadcast(bands)
    wider = F.sqrt(1 + F.try_divide(F.lit(float(SHORT)), F.col("n_grams")))
    out = scored.join(bands, "_lang", "left").withColumns({"band_low": F.col("_mid") - F.col("_down") * wider, "band_high": F.col("_mid") + F.col("_up") * wider})
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_mid", "_down", "_up")


def half() -> Column:
    """Language and half (of two, by the text) of a document."""
    return F.concat(F.coalesce("lang", F.lit("")), F.lit("\0"), (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2).cast("string"))


def quality(docs: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, broadcast_bytes: int = BROADCAST_MODEL_BYTES, held_out: bool = False) -> DataFrame:
    """All columns of ``docs`` (text and lang among them) with FEATURES, ``base_failed``, the band and ``kept``.

    With ``held_out`` a document is scored with the n-grams of the half of its language that it is not in, and its band
    is that of its half; else with those of all texts, its own among them, which pay for themselves: no way to judge.
    """
    spark = docs.sparkSession
    key, counted = "lang", docs
    if held_out:
        key, counted = "_half", docs.select("text", half().alias("lang"))
        docs = docs.withColumn("_half", half())
    counts = stage(count_ngrams(counted, order), "ngram-counts")
    probs, backoffs = kneser_ney(counts, order)
    # A half's own n-grams, under the model of the other one: the last sign of the key is the half.
    other = F.expr("concat(substring(lang, 1, length(lang) - 1), 1 - cast(right(lang, 1) as int))") if held_out else F.col("lang")
    grams = counts.select(F.col("lang").alias("key"), other.alias("lang"), "gram")
    values = hashed_values(gram_values(grams, probs, backoffs, order), order)
    if 12 * values.count() <= broadcast_bytes:
        none = np.zeros(0, np.uint64), np.zeros(0, "<f4")
        model = spark.sparkContext.broadcast((*value_arrays(values), *none))
        scored = stage(score(docs, model, order, key), "quality-scores")
    else:
        rows = stage(score(docs, None, order, key).drop("log_ppl").withColumn("_id", F.monotonically_increasing_id()), "quality-rows")
        found = score_by_values(rows, values, order, key)
        scored = stage(rows.join(found, "_id", "left").drop("_id"), "quality-scores")
    return judge(scored, lower, upper, key).drop("_half")
