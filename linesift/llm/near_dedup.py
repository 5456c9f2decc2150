"""Near duplicates by bottom-k sketches of word shingles under one hash function.

1. Each text gives its set of distinct 5-word shingles (64-bit hashes), a 128-bit name of the set, and the k smallest
   hashes (k = 256).  Texts with the same set form a class; from here on a class is one row.
2. Inverted lists of the 64 smallest values tell how many of them a class shares with any other.  A class that shares
   too few to have a partner is dropped; the lists of all 256 values then do the same more sharply.
3. Of its shared values a class is filed under the rarest ones, as many as a partner cannot miss all of.
4. In each list the most central class is the hub; all others are paired with it.  Classes found linked are merged; a
   second turn pairs what lies in other components than the hub with the rest of its list.  So a group of near copies
   costs one pair for each member, not all pairs.
5. A pair passes if both could share enough values at all, if the estimate from the sketch of the union allows it, and
   at last if the Jaccard similarity of the full sets reaches the threshold.  Components of these links are the groups.

A set of at most 0.85 * k shingles is judged exactly throughout.  Longer ones rely on sketches with a margin of 5.5
standard deviations: a pair exactly at the threshold is missed with a probability of about 1e-7, others less.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; with fewer than five
words the whole sequence is the one shingle; rows with a null doc_id take part, and a group's id is its smallest
non-null one; equal rows are in one group; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesift.llm import textblock as T
from linesift.llm.components import components
from linesift.llm.stage import numbered, ordered, stage

WORDS, THRESHOLD = 5, 85
#: Sketch sizes of the first and the second look, and the margin in standard deviations.
FIRST, K, MARGIN = 64, 256, 5.5
#: Rows of two numbers that are sent to every task at most; more of them are joined by a shuffle.
SMALL = 1_000_000


def shingle_sets(b: T.Block, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each document the sorted distinct shingle hashes (signed 64-bit)."""
    starts, ends, doc = T.word_spans(b)
    h = T.span_hash(T.lower(b.data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    win, at = T.windows(h, doc, words)
    at_doc = doc[at] if len(at) else np.zeros(0, np.int64)
    cut = np.searchsorted(at_doc, np.arange(b.n + 1))
    first = np.searchsorted(doc, np.arange(b.n + 1))
    for i in range(b.n):
        if cut[i] < cut[i + 1]:
            yield np.unique(win[cut[i] : cut[i + 1]].view(np.int64))
        elif first[i] < first[i + 1]:
            x = np.uint64(first[i + 1] - first[i])
            for y in h[first[i] : first[i + 1]]:
                x = T.mix(np.array([x ^ y], np.uint64))[0]
            yield np.array([x], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _set_rows(keys: pa.Array, sets: list[np.ndarray], k: int | None) -> pa.RecordBatch:
    held = [s if k is None else s[:k] for s in sets]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))
    names = []
    for s in sets:
        u = s.view(np.uint64)
        names.append(f"{int(T.mix(u).sum(dtype=np.uint64)):016x}{int(T.mix(u ^ np.uint64(T.STEP)).sum(dtype=np.uint64)):016x}")
    return pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(names), lists], names=["key", "n", "name", "hashes"])


def sketches(docs: DataFrame, key: str, k: int | None = K, words: int = WORDS) -> DataFrame:
    """``key, n, name, hashes``: set size, name of the set, its k smallest hashes (all of them for None)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in T.blocks(batch):
                yield _set_rows(batch.column(0).slice(b.lo, b.n), list(shingle_sets(b, words)), k)

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(run, "key long, n long, name string, hashes array<long>")


def least_shared(n: Column, k: int, percent: int) -> Column:
    """How many of its retained values a class of ``n`` shingles shares with any partner, at least."""
    j = percent / 100
    margin = math.floor(j * k - MARGIN * math.sqrt(k * j * (1 - j)))
    return F.least(F.ceil(n * F.lit(percent) / F.lit(100)), F.lit(margin)).cast("long")


def _sent(rows: DataFrame) -> DataFrame:
    """Staged rows of a few numbers, sent to every task if they are few: the wide side is then not shuffled."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _shared(postings: DataFrame) -> DataFrame:
    """Postings (v, cid, n) of values in two lists or more, with ``c``, the length of the list."""
    postings = postings.repartition("v")
    # The lengths name all columns (no class is empty): so they read the join's own shuffle, not a narrower one.
    lengths = postings.groupBy("v").agg(F.count("*").alias("c"), F.min("cid").alias("_lo"), F.max("cid").alias("_hi"), F.max("n").alias("_n"))
    return postings.join(lengths.where("_lo < _hi and _n > 0").select("v", "c"), "v")


def _survivors(shared: DataFrame, k: int, percent: int) -> DataFrame:
    """``cid, m`` (shared values) of the classes that may have a partner."""
    per = shared.groupBy("cid").agg(F.count("*").alias("m"), F.max("n").alias("_n"))
    return per.where(F.col("m") >= least_shared(F.col("_n"), k, percent)).select("cid", "m")


def _possible(percent: int) -> Column:
    """Whether two classes (n, m, r and hn, hm, hr) can reach the threshold by their sizes and shared values.

    At the first value that they share, of rank r and hr, only the values from there on can be shared as well; so where
    these are too few, no list of a later value needs the pair either.  Sets of K shingles at most are whole: the pair
    itself then says how many values it has to share, which is more than either class has to share with any partner.
    """
    rest = F.least(F.col("m") - F.col("r"), F.col("hm") - F.col("hr")) + 1
    enough = rest >= F.greatest(least_shared(F.col("n"), K, percent), least_shared(F.col("hn"), K, percent))
    fits = 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")
    exact = (100 + percent) * rest >= percent * (F.col("n") + F.col("hn"))
    return fits & enough & (exact | (F.col("n") > K) | (F.col("hn") > K))


def _link(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: by the union's sketch, then by the full sets."""
    side = lambda t, c: t.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}"))
    pairs = stage(pairs, "near-pairs")
    met = stage(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "near-met")
    held = reps.join(met, "cid", "left_semi")  # only sketches of classes in a pair travel further; not written once more
    both = pairs.join(side(held, "a"), "a").join(side(held, "b"), "b")
    common = F.array_intersect("ha", "hb")
    size = F.when((F.col("na") <= K) & (F.col("nb") <= K), F.size(common).cast("long"))
    union = F.slice(F.array_sort(F.array_union("ha", "hb")), 1, K)
    j = percent / 100
    seen = F.size(F.array_intersect(union, common)) / F.size(union)
    judged = both.select("a", "b", "na", "nb", size.alias("both"), F.when(size.isNull(), seen).alias("guess"))
    judged = judged.where(F.col("both").isNotNull() | (F.col("guess") >= j - MARGIN * math.sqrt(j * (1 - j) / K)))
    judged = stage(judged, "near-judged")
    reach = lambda x: 100 * x >= percent * (F.col("na") + F.col("nb") - x)
    sure = judged.where(reach(F.col("both"))).select("a", "b")
    open_ = judged.where(F.col("both").isNull()).select("a", "b", "na", "nb")
    ids = open_.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(reps.select("cid", "doc_id", "name"), "cid")
    ids = stage(ids, "near-ids")
    wanted = texts.join(_sent(ids.select("cid", F.col("doc_id").alias("_id"), "name")), F.col("doc_id").eqNullSafe(F.col("_id"))).select("cid", "text", F.col("name").alias("_name"))
    full = sketches(wanted, "cid", None, words).join(ids.select(F.col("cid").alias("key"), F.col("name")), ["key", "name"])
    full = stage(full.dropDuplicates(["key"]).select(F.col("key").alias("cid"), "hashes"), "near-sets")
    side = lambda c: full.select(F.col("cid").alias(c), F.col("hashes").alias(f"h{c}"))
    exact = open_.join(side("a"), "a").join(side("b"), "b").where(reach(F.size(F.array_intersect("ha", "hb")))).select("a", "b")
    return stage(sure.unionAll(exact), "near-links")


def _pairs(left: DataFrame, right: DataFrame, on, percent: int) -> DataFrame:
    found = left.join(right, on).where(F.col("cid") != F.col("hid")).where(_possible(percent))
    return found.select(F.greatest("cid", "hid").alias("a"), F.least("cid", "hid").alias("b")).distinct()


def class_links(sets: DataFrame, classes: DataFrame, texts: DataFrame, percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``node, component`` of the linked ``classes`` (cid, _row): ``sets`` (_row, n, name, doc_id, head, tail) has their sketches."""
    heads = sets.select("_row", "n", "head").join(classes.select("_row", "cid"), "_row")
    alive = _survivors(_shared(heads.select("cid", "n", F.explode("head").alias("v"))), FIRST, percent)
    alive = stage(classes.select("_row", "cid").join(alive.select("cid"), "cid"), "near-alive")
    # One row for each class that may have a partner: the sketch of its first document.
    reps = sets.join(_sent(alive), "_row").select("cid", "n", "name", "doc_id", F.concat("head", "tail").alias("hashes"))
    reps = stage(reps, "near-reps")
    postings = reps.select("cid", "n", F.explode("hashes").alias("v"))
    shared = stage(_shared(postings), "near-postings").drop("c")
    shared = _shared(shared.join(_survivors(shared, K, percent).select("cid"), "cid"))
    alive = _survivors(shared, K, percent)
    # A partner shares least_shared of the values, so it shares one of the first m - least_shared + 1 in any order.
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("c", "v"))  # K rows in a group at most
    filed = shared.join(alive, "cid").withColumn("r", rank).where(F.col("r") <= F.col("m") - least_shared(F.col("n"), K, percent) + 1)
    filed = stage(filed.select("v", "cid", "n", "m", "r"), "near-lists")
    central = F.struct((F.col("m") / F.least(F.col("n"), F.lit(K))).alias("share"), (-F.col("cid")).alias("cid"))
    hubs = filed.groupBy("v").agg(F.max_by(F.struct("cid", "n", "m", "r"), central).alias("h"), F.count("*").alias("c")).where("c > 1")
    hubs = stage(hubs.select("v", F.col("h.cid").alias("hid"), F.col("h.n").alias("hn"), F.col("h.m").alias("hm"), F.col("h.r").alias("hr")), "near-hubs")
    links = _link(_pairs(filed, hubs, "v", percent), reps, texts, percent, words)

    # The second turn: members outside their hub's component, against all members of their list but the hub.
    found = components(links)
    named = stage(filed.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "near-members")
    of_hub = found.select(F.col("node").alias("hid"), F.col("component").alias("_hc"))
    tops = hubs.select("v", "hid").join(of_hub, "hid", "left").select("v", F.col("hid").alias("_hub"), F.coalesce("_hc", "hid").alias("_hc"))
    strays = named.join(tops, "v").where((F.col("component") != F.col("_hc")) & (F.col("cid") != F.col("_hub"))).drop("_hc")
    others = named.select("v", F.col("cid").alias("hid"), F.col("n").alias("hn"), F.col("m").alias("hm"), F.col("r").alias("hr"), F.col("component").alias("_c"))
    # A pair is taken from the first list that both are filed in: the values before it, which travel along, have none in
    # common.  Lists without a stray are not read, and two strays of a list meet once in it.
    earlier = filed.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("_all"))
    before = lambda df, rank, out: df.withColumn(out, F.slice("_all", F.lit(1), F.col(rank).cast("int") - 1)).drop("_all")
    strays = stage(strays, "near-strays")
    is_stray = strays.select(F.col("v").alias("_v"), F.col("cid").alias("_id"), F.lit(True).alias("_is"))
    others = others.join(strays.select("v").distinct(), "v", "left_semi")
    others = others.join(is_stray, (F.col("v") == F.col("_v")) & (F.col("hid") == F.col("_id")), "left").withColumn("_stray", F.coalesce("_is", F.lit(False))).drop("_v", "_id", "_is")
    others = before(others.join(earlier.withColumnRenamed("cid", "hid"), "hid"), "hr", "_before_h")
    strays = before(strays.join(earlier, "cid"), "r", "_before")
    once = (F.col("cid") < F.col("hid")) | ~F.col("_stray")
    rest = strays.join(others, (strays["v"] == others["v"]) & (F.col("component") != F.col("_c")) & (F.col("hid") != F.col("_hub")) & once & _possible(percent) & ~F.arrays_overlap("_before", "_before_h"))
    rest = rest.select(F.greatest("cid", "hid").alias("a"), F.least("cid", "hid").alias("b")).distinct()
    more = _link(rest, reps, texts, percent, words)
    contracted = links.unionAll(more)
    return components(contracted)


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = sketches(texts, "doc_id", K, words).withColumn("_row", F.monotonically_increasing_id())
    halves = [F.slice("hashes", 1, FIRST).alias("head"), F.slice("hashes", FIRST + 1, K).alias("tail")]  # the first look reads the head alone
    sets = stage(sets.select(F.col("key").alias("doc_id"), "n", "name", "_row", *halves), "near-sketches")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    classes = sets.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.min_by("_row", first).alias("_row"))
    classes = numbered(ordered(classes, ["least", "name"], "near-classes")).select("name", "least", "_row", F.col("_rank").alias("cid"))
    classes = stage(classes, "near-class-ids")
    groups = class_links(sets, classes, texts, percent, words)
    label = classes.drop("_row").join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = label.groupBy("component").agg(F.min("least").alias("component_id"))
    label = stage(label.join(best, "component").select("name", F.col("cid").alias("class_id"), "component_id"), "near-labels")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).alias("name")).join(label, "name", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
