"""Encoder, packing, token files, counts and n-best."""

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linesift.llm import nbest, packing, token_counts, token_file
from linesift.llm.encoder import Encoder
from linesift.llm.queries import tokenizer
from linesift.llm.unigram import marked, pretokens, unigram

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_cached_encoder_equals_the_library(name, hard_rows):
    enc, want = Encoder(tokenizer(name)), plain(name)
    texts = [t or "" for _, t, *_ in hard_rows]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [want(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé's ,.\n\t\u00a0\u3000<|3日"), max_size=30), max_size=8))
def test_encoder_on_odd_texts(texts):
    for name in FILES:
        want = plain(name)
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer(name)).encode(texts)] == [want(t) for t in texts]


def test_odd_white_space_is_what_the_pattern_finds():
    """The look-up by single kinds against the one class of characters it stands for, on every white space there is."""
    import random
    import re

    from linesift.llm.encoder import _odd_space

    odd = re.compile(r"[^\S \n]|[ \n]{2}|^[ \n]|[ \n]\Z").search
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    rng = random.Random(11)
    texts = ["", *spaces, *(f"a{c}b" for c in spaces), *(f"é{c}日" for c in spaces)]
    texts += ["".join(rng.choice(["a", "é", "\U0001f389", " ", "\n", "\u200b", "\x00", rng.choice(spaces)]) for _ in range(rng.randrange(8))) for _ in range(5000)]
    assert [_odd_space(t) for t in texts] == [bool(odd(t)) for t in texts]


def test_packing(spark, hard, hard_rows, none):
    path, want = tokenizer("word_bpe_49k.json"), plain("word_bpe_49k.json")
    got = packing.pack_documents(hard.withColumnRenamed("source", "offset"), path).collect()
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    ids = defaultdict(list)
    for k, t, *_ in hard_rows:
        ids[k].append([*want(t), 2])
    for k, texts in ids.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in docs[k])
        cut = [(a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes()), len(x)) for x in texts for a in range(0, len(x), 4096)]
        assert pieces == sorted(cut)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(sequences) <= math.ceil(total / 4096) + 2
    assert packing.pack_documents(none, path).count() == 0


def test_column_generation_reaches_the_optimum_of_small_programs():
    rng = random.Random(3)
    for _ in range(10):
        demand = np.zeros(21)
        for _ in range(6):
            demand[rng.randrange(3, 21)] += rng.randrange(1, 40)
        columns, bound = packing.solve_patterns(demand, gap=0)
        assert sum(k for _, k in columns) <= bound * (1 + 1e-6) + 1e-6
        assert np.allclose(sum(a * k for a, k in columns), demand)
        whole = packing.round_patterns(demand, columns)
        assert (sum(a * n for a, n in whole) == demand).all() and all(a @ np.arange(21) <= 20 for a, _ in whole)
        assert sum(n for _, n in whole) <= math.ceil(bound) + 3


def test_knapsack_prices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        duals = np.zeros(13)
        sizes = rng.choice(np.arange(2, 13), 4, replace=False)
        duals[sizes] = rng.random(4)
        value, pattern = packing.price(duals, 12)
        best = max(sum(duals[s] * c for s, c in zip(sizes, k, strict=True)) for k in itertools.product(range(7), repeat=4) if sum(s * c for s, c in zip(sizes, k, strict=True)) <= 12)
        assert math.isclose(value, best, abs_tol=1e-9) and pattern @ np.arange(13) <= 12 and math.isclose(pattern @ duals, best, abs_tol=1e-9)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60))
def test_code_lengths_are_limited_and_optimal(counts):
    import heapq

    c = np.array(counts)
    full = token_file.code_lengths(c, 18)
    used = c > 0
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in full[used]) == 1.0
        heap, cost = sorted(int(x) for x in c[used]), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((full.astype(int) * c).sum()) == cost  # 60 counts up to 5000 never need more than 18 bits
        assert token_file.code_lengths(c, 6).max() <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=900), st.integers(0, 2**32))
def test_round_trip_of_bits(ids, seed):
    a = np.array(ids, np.uint32)
    counts = np.bincount(a, minlength=301) * np.random.default_rng(seed).integers(1, 10**6, 301)
    lengths = token_file.code_lengths(counts)
    bits, marks = token_file.encode_bits(a, token_file.canonical_codes(lengths), lengths, 64)
    assert token_file.decode_bits(bits, marks, len(a), *token_file.decode_table(lengths), stride=64).tolist() == ids


def test_token_files(spark, hard, hard_rows, none, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 3000)
    path, want = tokenizer("byte_bpe_50k.json"), plain("byte_bpe_50k.json")
    got = token_file.token_files(hard.withColumnRenamed("source", "start"), path).collect()
    ids = [[*want(t), 0] for _, t, *_ in hard_rows]
    expected = sorted(((k is not None, k or 0), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, *_), x in zip(hard_rows, ids, strict=True))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert token_file.token_files(none, path).count() == 0


def cuts(word, model):
    """All segmentations of a short word, scored."""
    if not word:
        yield 0.0, ()
        return
    for n in range(1, len(word) + 1):
        node = model.trie
        for c in word[:n]:
            node = node.get(c) if node is not None else None
        if node is not None and "" in node:
            for s, ids in cuts(word[n:], model):
                yield model.score[node[""]] + s, (node[""], *ids)
        elif n == 1:
            raw = tuple(model.fallback(word[0]))
            for s, ids in cuts(word[1:], model):
                yield len(raw) * model.byte_score + s, (*raw, *ids)


WORDS = ["▁the", "▁then", "▁thereof", "▁", "▁▁▁x", "abc", "▁🎉é", "▁running", "日本", "▁12345", "▁don't"]


def test_trie_counts_against_all_segmentations():
    model = unigram(tokenizer("piece_bpe_32k.model"))
    got = token_counts.terminal_counts(WORDS, model)
    for w in WORDS:
        best = max(s for s, _ in cuts(w, model))
        n, s = got[w]
        assert math.isclose(s, best, abs_tol=1e-9)
        assert n == min(len(ids) for t, ids in cuts(w, model) if math.isclose(t, best, abs_tol=1e-12))


def test_trie_counts_against_the_library():
    from tokenizers import Tokenizer, models

    model = unigram(tokenizer("piece_bpe_32k.model"))
    other = Tokenizer(models.Unigram([("<unk>", -100.0)] + [(model.text[i], s) for i, s in model.score.items()], 0))
    rng = random.Random(5)
    words = {"▁" + "".join(rng.choice("aeionrstdlhmc") for _ in range(rng.randrange(1, 14))) for _ in range(2000)}
    got = token_counts.terminal_counts(words, model)
    score = {model.text[i]: s for i, s in model.score.items()}
    for w in words:
        pieces = other.encode(w).tokens
        assert math.isclose(sum(score[p] for p in pieces), got[w][1], abs_tol=1e-6)


def test_n_best_against_all_segmentations():
    model = unigram(tokenizer("piece_bpe_32k.model"))
    for w in WORDS:
        every = sorted((-s for s, _ in cuts(w, model)))
        for n in (1, 3, 6):
            got = nbest.n_best(w, model, n)
            assert np.allclose([-s for s, _ in got], every[:n]) and len({ids for _, ids in got}) == len(got)


def test_table_of_beginnings_does_not_change_the_lattice(monkeypatch):
    """Whatever is kept of it: the same n best as all segmentations, and the table is bounded."""
    model = unigram(tokenizer("piece_bpe_32k.model"))
    monkeypatch.setattr(nbest, "HEADS", 5)
    for head in (1, 2, 3, 9):
        monkeypatch.setattr(nbest, "HEAD", head)
        model.starts.clear()
        for w in WORDS:
            every = sorted(-s for s, _ in cuts(w, model))
            assert np.allclose([-s for s, _ in nbest.n_best(w, model, 6)], every[:6])
            assert len(model.starts) <= 5
            best = nbest.Known(w, model, 3)
            ids = np.frombuffer(best.choices[0][1], "<u4").tolist()
            assert best.spelt == (model.decode([model.first_mark, *ids]) == w.replace("▁", " "))
    model.starts.clear()


def test_n_best_of_texts_and_counts_on_hard_rows(spark, hard, hard_rows, none):
    path = tokenizer("piece_bpe_32k.model")
    model = unigram(path)
    text = "the then a"
    lists = [list(cuts(w, model)) for w in pretokens(marked(text))]
    every = sorted(-sum(s for s, _ in pick) for pick in itertools.product(*lists))
    got = {r["doc_id"]: r for r in nbest.encode_n_best(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, 4).collect()}
    assert np.allclose([-s for s in got[1]["scores"]], every[:4])
    rows = nbest.encode_n_best(hard, path).collect()
    counts = token_counts.token_counts(hard, path).collect()
    assert len(rows) == len(counts) == len(hard_rows)
    assert sorted(r["decoded_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in hard_rows) and all(r["round_trip"] for r in rows)
    best = {r["doc_id"]: (r["n_pieces"], r["scores"][0]) for r in rows if r["doc_id"] is not None}
    for r in counts:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == best[r["doc_id"]][0] and math.isclose(r["log_score"], best[r["doc_id"]][1], rel_tol=1e-9, abs_tol=1e-9)
    assert nbest.encode_n_best(none, path).count() == token_counts.token_counts(none, path).count() == 0


def test_n_best_of_a_text_changes_the_cheapest_words(monkeypatch):
    """Against all products of choices, and for n that products could not reach."""
    model = unigram(tokenizer("piece_bpe_32k.model"))
    words = [nbest.Known(w, model, 10) for w in ["▁thereof", "▁running", "▁12345", "▁nothing", "▁don't", "▁otherwise"] * 3]
    got = nbest.combine(words, 10)
    assert len(got) == 10 and got[0] == (0.0, {})
    few = words[:4]
    products = sorted(sum(w.choices[0][0] - w.choices[j][0] for w, j in zip(few, pick, strict=True)) for pick in itertools.product(*[range(len(w.choices)) for w in few]))
    assert np.allclose([loss for loss, _ in nbest.combine(few, 10)], products[:10])
    for loss, changed in got:
        assert math.isclose(loss, sum(words[i].choices[0][0] - words[i].choices[j][0] for i, j in changed.items()), abs_tol=1e-9)


def test_caches_are_bounded_by_bytes(monkeypatch):
    from linesift.llm import encoder

    monkeypatch.setattr(encoder, "GENERATION", 100_000)
    enc, want = Encoder(tokenizer("word_bpe_49k.json")), plain("word_bpe_49k.json")
    for i in range(40):
        text = f"汉字{i}" * 2000 + f" word{i}"
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == want(text)
        assert sum(map(len, enc.new.values())) + sum(map(len, enc.old.values())) < 400_000
    monkeypatch.setattr(nbest, "GENERATION", 50_000)
    worker = nbest.Segmenter(tokenizer("piece_bpe_32k.model"), 3)
    for i in range(300):
        assert f"▁w{i}" in worker.look_up([[f"▁w{i}", "▁again"]])
        assert len(worker.new) + len(worker.old) < 200


def test_token_files_are_read_by_their_folder_alone(spark, hard):
    staged = token_file.staged_ids(hard, tokenizer("byte_bpe_50k.json"), 0)
    folder = token_file.write_files(staged, token_file.global_counts(staged))
    fresh = spark.newSession()
    got = sorted((r["n_tokens"], r["ids_crc32"]) for r in token_file.read_files(fresh, folder).collect())
    assert got == sorted((r["n_tokens"], r["ids_crc32"]) for r in token_file.token_files(hard, tokenizer("byte_bpe_50k.json")).collect())
