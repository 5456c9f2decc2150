"""Quality rules, toxicity, near duplicates, fingerprints, the pipeline."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesift.llm import fingerprints, near_dedup, quality, toxicity
from linesift.llm import textblock as T
from linesift.llm.stage import stage

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_model(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def kn_model(texts, order):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    c = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    below = {"": 1 / (len(c[1]) + 1)}
    for k in range(1, order + 1):
        n = Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] else 0.5 for i in (1, 2, 3)}
        cut = lambda v: min(d[min(v, 3)], v)  # noqa: B023, E731
        total, free = Counter(), Counter()
        for g, v in c[k].items():
            total[g[:-1]] += v
            free[g[:-1]] += cut(v)
        below = {g: (v - cut(v)) / total[g[:-1]] + free[g[:-1]] / total[g[:-1]] * below[g[1:]] for g, v in c[k].items()}
    return below


def test_base_counts_and_perplexity(spark, hard, hard_rows, none):
    docs = hard.withColumnRenamed("source", "kept").withColumnRenamed("n_chars", "n_words")
    out = quality.quality(docs)
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out.collect())
    assert got == sorted(((k or -1), *base_model(t)) for k, t, *_ in hard_rows)
    for r in out.collect():
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["base_failed"] and r["kept"])
    texts = defaultdict(list)
    norm = lambda t: re.sub(r"[\x09-\x0D]", " ", t or "")
    for _, t, lang, *_ in hard_rows:
        texts[lang or ""].append(norm(t))
    models = {x: kn_model(t, quality.ORDER) for x, t in texts.items()}
    wanted = defaultdict(list)
    for k, t, lang, *_ in hard_rows:
        t, p = norm(t), models[lang or ""]
        grams = [t[i : i + 5] for i in range(len(t) - 4)]
        wanted[k].append(-sum(math.log(p[g]) for g in grams) / len(grams) if grams else None)
    for r in out.collect():
        assert any((r["log_ppl"] is None and w is None) or (w is not None and r["log_ppl"] is not None and math.isclose(r["log_ppl"], w, rel_tol=1e-4)) for w in wanted[r["doc_id"]])
    assert quality.quality(none).count() == 0


def test_large_model_by_joins_gives_the_same(spark, hard):
    a = {(r["doc_id"], r["n_words"], r["log_ppl"] and round(r["log_ppl"], 4), r["kept"]) for r in quality.quality(hard).collect()}
    b = {(r["doc_id"], r["n_words"], r["log_ppl"] and round(r["log_ppl"], 4), r["kept"]) for r in quality.quality(hard, broadcast_bytes=0).collect()}
    assert a == b


def test_unseen_ngrams_back_off(spark, hard):
    counts = quality.count_ngrams(hard)
    probs, backoffs = quality.kneser_ney(counts)
    model = (*quality.hash_arrays(probs, "logp"), *quality.hash_arrays(backoffs, "logb"))
    new = spark.createDataFrame([(0, "quite unseen wording w1 w2", "en"), (1, "zzz", "en"), (2, "w1 w2 qq", "xx")], "_id long, text string, lang string")
    arrays = {r["_id"]: r["log_ppl"] for r in quality.score(new, spark.sparkContext.broadcast(model)).collect()}
    joined = {r["_id"]: r["log_ppl"] for r in quality.score_by_joins(new, probs, backoffs).collect()}
    assert arrays[1] is None and 1 not in joined
    assert all(math.isclose(arrays[i], joined[i], rel_tol=1e-4) for i in (0, 2))


def test_held_out_scores_come_from_the_other_half(spark, hard, hard_rows):
    docs = hard.select("text", "lang")
    side = {t: zlib.crc32((t or "").encode()) % 2 for _, t, *_ in hard_rows}
    wanted = {}
    for h in (0, 1):
        texts = spark.createDataFrame([(t, x) for _, t, x, *_ in hard_rows if side[t] != h], "text string, lang string")
        probs, backoffs = quality.kneser_ney(quality.count_ngrams(texts))
        model = spark.sparkContext.broadcast((*quality.hash_arrays(probs, "logp"), *quality.hash_arrays(backoffs, "logb")))
        wanted |= {(r["text"], r["lang"] or ""): r["log_ppl"] for r in quality.score(docs, model).collect() if side[r["text"]] == h}
    for size in (quality.BROADCAST_MODEL_BYTES, 0):
        out = quality.quality(hard, broadcast_bytes=size, held_out=True)
        assert out.columns == quality.quality(hard).columns
        rows = out.collect()
        assert len(rows) == len(hard_rows)
        for r in rows:
            w = wanted[r["text"], r["lang"] or ""]
            assert (w is None) == (r["log_ppl"] is None) and (w is None or math.isclose(w, r["log_ppl"], rel_tol=1e-4))


def banded(rows):
    """Whether each row (half, n_words, n_repeat_words, log_ppl, n_grams) is kept: quartiles of the half by sorting."""
    failed = lambda r: r[1] < 20 or 100 * r[2] > 30 * r[1]
    values = defaultdict(list)
    for r in rows:
        if not failed(r) and r[3] is not None:
            values[r[0]].append(r[3])
    out = []
    for r in rows:
        inside = True
        if r[3] is not None and r[0] in values:
            v = sorted(values[r[0]])
            low, mid, high = (v[max(0, math.ceil(len(v) * q) - 1)] for q in (0.25, 0.5, 0.75))
            wide = math.sqrt(1 + 2000 / r[4])
            inside = mid - 4 * max(mid - low, 0.01) * wide <= r[3] <= mid + 4 * max(high - mid, 0.01) * wide
        out.append(not failed(r) and inside)
    return out


def test_ngrams_are_written_once_for_each_step(spark, hard, monkeypatch):
    """The probabilities and the values of the longest n-grams have one copy on disk, in one shuffle less."""
    names, plain = [], quality.stage

    def named(df, name, *more):
        names.append(name)
        return plain(df, name, *more)

    monkeypatch.setattr(quality, "stage", named)
    quality.quality(hard, held_out=True)
    assert sorted(names) == sorted(["ngram-counts", *(f"grams-{k}" for k in range(1, 5)), *(f"probabilities-{k}" for k in range(1, 6)), *(f"values-{k}" for k in range(1, 5)), "ngram-values", "quality-scores", "quality-bands"])


def test_bands_are_the_same_for_a_model_of_any_size(spark):
    """Noise among real documents is rejected by a model that is sent around and by one that is joined."""

    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and doc_id < 700").select("doc_id", "text", "lang")
    noise = [(-1 - i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(2, 10))) for _ in range(n)), "en") for i, n in enumerate((25, 40, 200, 400) * 3)]
    docs = stage(docs.unionAll(spark.createDataFrame(noise, docs.schema)), "noisy")
    found = {}
    for size in (quality.BROADCAST_MODEL_BYTES, 0):
        rows = quality.quality(docs, broadcast_bytes=size, held_out=True).collect()
        found[size] = {r["doc_id"]: (r["kept"], r["n_grams"], r["log_ppl"] and round(r["log_ppl"], 5), r["band_low"] is None) for r in rows}
        assert not any(found[size][k][0] for k, *_ in noise)
        key = lambda r: zlib.crc32((r["text"] or "").encode()) % 2
        model = banded([(key(r), r["n_words"], r["n_repeat_words"], r["log_ppl"], r["n_grams"]) for r in rows])
        assert [r["kept"] for r in rows] == model
    assert found[0] == found[quality.BROADCAST_MODEL_BYTES]
    real = [v[0] for k, v in found[0].items() if k >= 0]
    assert 0.8 * len(real) < sum(real) < len(real)


def test_planted_noise_is_rejected_and_excerpts_are_kept(spark):
    """Short and long noise among the documents of sf0.01, one text of it twice; excerpts of the documents themselves."""
    import base64

    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    long_texts = [r["text"].split() for r in docs.orderBy("doc_id").limit(300).collect() if len(r["text"].split()) > 400]
    word = {
        "base64": lambda: base64.b64encode(rng.randbytes(rng.randrange(3, 9))).decode(),
        "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))),
        "hex": lambda: rng.randbytes(rng.randrange(2, 6)).hex(),
        "tails": lambda: rng.choice(rng.choice(long_texts)) + "".join(rng.choice("#*$%&|<>") for _ in range(rng.randrange(1, 4))),
    }
    noise = [" ".join(f() for _ in range(n)) for f in word.values() for n in (25, 40, 400) for _ in range(3)]
    noise.append(noise[3])
    good = [" ".join(w[:n]) for w in long_texts[:4] for n in (25, 40, 400)]
    planted = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(noise)] + [(-1000 - i, t, "en") for i, t in enumerate(good)], docs.schema)
    rows = quality.quality(docs.unionAll(planted), held_out=True).collect()
    assert not [r["text"][:60] for r in rows if -1000 < r["doc_id"] < 0 and (r["kept"] or r["base_failed"])]
    assert all(r["kept"] for r in rows if r["doc_id"] <= -1000)
    real = [r["kept"] for r in rows if r["doc_id"] >= 0 and not r["base_failed"]]
    assert sum(real) >= 0.95 * len(real)


def test_folding_and_exceptions():
    assert toxicity.fold("ID10T, you М0R0N! 2024 (x)") == " idiot you moron 2024 x "
    assert toxicity.fold(None) == toxicity.fold("") == "  "
    lex = toxicity.Lexicon({" idio": 2.0, " scum ": 3.0}, ("pond scum",), (1.0, -3.0))
    m = toxicity.matcher(lex)
    assert m.rate("pond scum") == 0 and m.rate("scum") == 3.0 and m.rate("idiotic scumbag") == 1.0
    assert m.score(m.rate("scum")) > 0.5 > m.score(0.0)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.learn(docs, labels)
    assert lex.weights
    rows = toxicity.score(docs.select("doc_id", "text"), lex).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)


def test_toxicity_on_hard_rows(spark, hard, hard_rows, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 1")):
        lex = toxicity.learn(hard, lab)
        rows = toxicity.score(hard.withColumnRenamed("source", "score"), lex).collect()
        assert len(rows) == len(hard_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Smallest reachable doc_id of each row, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(s), least.get(find(i)) if s else k) for i, ((k, *_), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark, hard, hard_rows, none):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    out = near_dedup.near_duplicates(hard.withColumnRenamed("source", "class_id")).collect()
    assert sorted(map(key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out))) == sorted(map(key, groups(hard_rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_copies_of_near_copies_and_long_texts(spark):
    """Chains (each like the next only), a group around a base, and texts longer than the sketch."""

    rng = random.Random(11)
    rows = []
    w = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(8):
        rows.append((100 + i, " ".join(w)))
        w = w.copy()
        for j in range(3):
            w[i * 36 + j * 12] = f"n{rng.randrange(10**6)}"
    for size, first in ((150, 200), (900, 300)):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        for i in range(30):
            x = base.copy()
            for j in rng.sample(range(size), int(size * rng.random() * 0.04)):
                x[j] = f"m{rng.randrange(10**6)}"
            rows.append((first + i, " ".join(x[: size - (i % 4) * size // 40])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(groups(rows))


def parsed_slowly(text):
    """The fingerprint by the definition, symbol by symbol."""
    mask = (1 << 64) - 1
    mix = lambda x: int(T.mix(np.array([x & mask], np.uint64))[0])

    def runs(symbols):
        out = []
        for x in symbols:
            if out and out[-1][0] == x:
                out[-1][1] += 1
            else:
                out.append([x, 1])
        return out

    def toss(labels):
        out = [labels[0] & 1]
        for left, own in zip(labels, labels[1:]):
            low = 0
            while left != own and not (left ^ own) >> low & 1:
                low += 1
            out.append(2 * low + (own >> low & 1))
        return out

    found, level = set(), 0
    labels = [x for x, _ in runs(text)]
    names = [mix(x + (n << 8) + 1) for x, n in runs(text)]
    while names:
        level += 1
        for _ in range(3 if level == 1 else 4):  # down to six labels, from bytes or from names
            labels = toss(labels)
        cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]] + [len(labels)]
        phrases = [mix(sum(x * pow(T.BASE, j, 1 << 64) for j, x in enumerate(names[a:z])) + z - a) for a, z in zip(cuts, cuts[1:])]
        if level >= 3 or len(phrases) <= 64:
            found |= {(x >> 32 & ~3) | min(level, 3) for x in phrases}
        if len(phrases) == 1:
            break
        names = [mix(x + n * T.STEP) if n > 1 else x for x, n in runs(phrases)]
        labels = names
    return sorted(found)[:64] or [0]


def like_slowly(a, b):
    if a == b:
        return 1.0
    level = max(min(x % 4 for x in a), min(x % 4 for x in b))
    top = min([v[-1] for v in (a, b) if len(v) == 64], default=1 << 40)
    a, b = ([x for x in v if x <= top and x % 4 >= level] for v in (a, b))
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def test_fingerprints(spark, hard, hard_rows, none):
    got = fingerprints.compare_edited(hard.withColumnRenamed("source", "fingerprint")).collect()
    rows = sorted(((k, t or "") for k, t, *_ in hard_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = [parsed_slowly(t.encode()) for _, t in rows]
    hexed = lambda names: "".join(f"{x:08x}" for x in names)
    want = []
    for i, (k, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        changed = t[: len(t) - len(t) // 3] + rows[j][1][: len(t) // 3]
        after = parsed_slowly(changed.encode())
        want.append((k or -1, len(t), hashlib.sha256(changed.encode()).hexdigest(), hexed(prints[i]), hexed(after), like_slowly(prints[i], after), like_slowly(prints[i], prints[j])))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    assert fingerprints.compare_edited(none).count() == 0
    one = spark.createDataFrame([(5, "only text here")], "doc_id long, text string")
    assert fingerprints.compare_edited(one).first()["near_next"] == 1.0
    # Rows without a key, and rows of one key, are split over partitions.
    same = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" text")).alias("text"))
    assert max(r["count"] for r in fingerprints.neighbours(same).groupBy("part").count().collect()) < 1500


def test_short_texts_keep_their_short_phrases():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)]
    for size in (8, 12, 20, 40, 120, 600):
        near, far = [], []
        for _ in range(40):
            a, b = (" ".join(rng.choices(words, k=size)) for _ in range(2))
            x, y, z = fingerprints.fingerprints([a.encode(), fingerprints.edited(a, b).encode(), b.encode()])
            near.append(fingerprints.likeness(x, y))
            far.append(fingerprints.likeness(x, z))
        assert np.mean(near) > 0.35 and np.mean(far) < 0.1, size


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(2)
    inner = bytes(rng.integers(97, 110, 4000).astype(np.uint8))
    for shift in (1, 2, 17, 1000):
        other = bytes(rng.integers(97, 110, shift).astype(np.uint8)) + inner
        for (level, a, *_), (_, b, *_) in zip(fingerprints.parse(np.frombuffer(inner, np.uint8), np.array([0, len(inner)])), fingerprints.parse(np.frombuffer(other, np.uint8), np.array([0, len(other)])), strict=False):
            if level <= 4:
                assert sum((Counter(a.tolist()) - Counter(b.tolist())).values()) <= 8  # only next to the ends
    x = fingerprints.fingerprints([b"", b"", b"a", b"aaaa" * 500, inner, inner])
    assert (x[0] == x[1]).all() and (x[4] == x[5]).all() and all(len(v) for v in x)


def test_pipeline_stages_against_brute_force(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["quality_stage", "toxicity_stage", "near_dedup_stage", "packing_stage"]
    good = P.quality_stage(spark, docs, SMALL)
    assert good.columns == docs.columns
    clean = P.toxicity_stage(spark, good, SMALL)
    unique = P.near_dedup_stage(spark, clean, SMALL)
    before = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in unique.collect()} == {k for k, _ in surviving(before, 80)}
    all_rows = {r["doc_id"]: base_model(r["text"]) for r in docs.collect()}
    assert all(all_rows[r["doc_id"]][0] >= 20 for r in good.collect())
    packed = P.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in unique.collect()}
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in packed)


def surviving(rows, percent):
    """Of each group, by comparing all pairs, the row with the smallest id (null ids last); of equal rows without words, one."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            alike = 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)
            if alike if a and b else rows[i] == rows[j]:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0, i)), (k is None, k or 0, i))
    return [rows[i] for _, _, i in least.values()]


def test_near_duplicate_stage_links_from_eighty_percent(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = {k for k, _ in surviving(rows, 80)}
    assert wanted != {k for k, _ in surviving(rows, 85)}
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, SMALL).collect()} == wanted


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, hard, hard_rows):
    """Repeated rows, one id with two texts (one a copy of another document), null ids in groups of their own."""
    import corpus_pipeline as P

    words = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    more = [(7, words[0]), (7, words[1]), (6, words[1]), (None, words[2]), (None, words[2]), (None, words[2] + " end"), (None, words[0]), (70, ""), (70, ""), (71, None), (71, None), (71, " ")]
    rows = [(k, t) for k, t, *_ in hard_rows] + more
    extra = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in more], hard.schema)
    out = P.near_dedup_stage(spark, hard.unionAll(extra).repartition(5), SMALL)
    assert out.columns == hard.columns
    # Of rows with one id in one group any text may stay: compared are ids, and texts where the id has one text.
    got, wanted = [(r["doc_id"], r["text"]) for r in out.collect()], surviving(rows, 80)
    texts = defaultdict(set)
    for k, t in rows:
        texts[k].add(t)
    single = lambda found: Counter((k, t) for k, t in found if len(texts[k]) == 1)
    assert Counter(k for k, _ in got) == Counter(k for k, _ in wanted)
    assert single(got) == single(wanted)
    assert [t for k, t in got if k == 7] == [words[0]] and [t for k, t in got if k == 6] == [words[1]]
    assert len(got) == len(wanted) < len(rows)


@pytest.mark.parametrize("case", ["none", "hard"])
def test_pipeline_stages_on_hard_rows(spark, request, case):
    import corpus_pipeline as P

    docs = request.getfixturevalue(case)
    for i, (_, f) in enumerate(P.STAGES):
        docs = f(spark, docs, SMALL)
        docs.collect()
        if i < 3:
            assert docs.columns == request.getfixturevalue(case).columns


def test_matches_of_very_long_texts_are_found_in_linear_time():
    import time

    rng = random.Random(4)
    lex = toxicity.Lexicon({" awful ": 2.0, "rude": 1.0}, ("so awful", "awful good", "crude oil"), (1.0, 0.0))
    m = toxicity.Matcher(lex)
    for _ in range(200):  # against all pairs of a match and a phrase
        text = toxicity.fold(" ".join(rng.choice(["so", "awful", "good", "rude", "crude", "oil", "x"]) for _ in range(rng.randrange(40))))
        spared = [(i, i + len(p) + 2) for p in lex.phrases for i in range(len(text)) if text.startswith(f" {p} ", i)]
        hits = [(i, i + len(e), w) for e, w in lex.weights.items() for i in range(len(text)) if text.startswith(e, i)]
        assert sorted(m.matches(text)) == sorted(h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared))
    long = "so awful it was, awful good and awful\n" * 55_000
    began = time.process_time()
    assert m.rate(long) > 0 and len(long) > 2_000_000
    assert time.process_time() - began < 5


def test_template_group_below_the_threshold(spark):
    """300 documents that share 75 to 84 % of a template: no link is made up, and planted ones among them are found."""

    rng = random.Random(6)
    template = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(300):
        w, at = list(template), rng.randrange(300)
        w[at : at + 70] = [f"d{i}x{j}" for j in range(70)]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " one more") for i in range(0, 300, 30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(groups(rows))
    assert sum(r["component_id"] != r["doc_id"] for r in got) >= 10


def test_only_sketches_that_may_have_a_partner_are_written_again(spark, monkeypatch):
    """Of 60 unrelated texts, two copies and one near copy, the sketches of the near pair alone go on."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(80))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, rows[7][1] + " more")]
    staged, plain = {}, near_dedup.stage

    def kept(df, name, *more):
        staged[name] = plain(df, name, *more)
        return staged[name]

    monkeypatch.setattr(near_dedup, "stage", kept)
    for small in (near_dedup.SMALL, 0):  # sent around, and joined by a shuffle
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(groups(rows))
        assert staged["near-sketches"].count() == 63 and staged["near-reps"].count() == 2


def test_near_copies_below_the_threshold_meet_in_few_pairs(spark, monkeypatch):
    """Copies of one text with some words replaced: those too far from it are not paired with all that are near it."""
    rng = random.Random(11)
    text = [f"t{i}" for i in range(150)]
    rows = [(-1, " ".join(text))]
    for i in range(240):
        w = list(text)
        for at in rng.sample(range(150), 4 if i % 4 == 0 else 2):
            w[at] = f"r{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    pairs, plain = [], near_dedup.stage

    def counted(df, name, *more):
        out = plain(df, name, *more)
        if name == "near-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(groups(rows))
    assert sum(r["component_id"] == r["doc_id"] for r in got) > 20
    assert sum(pairs) < 1500, pairs
