"""Preset dictionary, the one-pass multi-pattern scan, and the recency-deduplicated history."""

import datetime as dt
import io
import random
import re

from conftest import segments_of
from linesift.operators import history, presets
from linesift.sources.presets import by_label, preset_list, presets_frame, write_presets_json

INLINE = ("def f(x):\nclass A:\nimport os\n# TODO: x\n\"k\": 1\n\n550e8400-e29b-41d4-a716-446655440000\n"
          "#ff8800\nhttps://a.example/x\nGET /a 404 12\n2024-01-31\n12:34:56\nひらがな\nカタカナ\n漢字\n03-1234-5678\n"
          "<b>x</b> trailing \nmail a.b@c.de 10.0.0.1")


def test_many_patterns_by_their_guards(spark):
    """4,000 patterns and the presets, repeated rows and patterns without a guard among them, against testing each one."""
    import random

    from linesift.sources.presets import PATTERNS_SCHEMA

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    lines = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(300)] + INLINE.split("\n") + ["", "ab", "\U0001f389\U0001f389ab 日本語"]
    segs = segments_of(spark, [("f.txt", "\n".join(lines))])
    rows = list(preset_list())
    for i in range(4000):
        w = word()
        rows.append(rng.choice([("w", i, w, w, False), ("w", i, w, rf"\b{w}\b", True), ("w", i, w, f"{w}+ [a-d]", True), ("w", i, w, f"[{w}]x?{w}|{w}$" if i % 50 == 0 else w, i % 50 == 0)]))
    rows += [rows[30], ("w", 5000, "emoji", "\U0001f389ab", False), ("w", 5001, "empty", "", False), ("w", 5002, "jp", "日本語", False)]
    got = sorted((r.line_number, r.category, r.ord, r.label) for r in presets.preset_scan_table(segs, spark.createDataFrame(rows, PATTERNS_SCHEMA)).collect())
    want = []
    for n, line in enumerate(lines, 1):
        text = line + "\n" * (n < len(lines))
        for c, o, label, p, is_regex in rows:
            if text and (re.search(p, text) if is_regex else p in text):
                want.append((n, c, o, label))
    assert got == sorted(want) and len(got) > 1000
    empty = presets.preset_scan_table(segs, spark.createDataFrame([], PATTERNS_SCHEMA))
    assert empty.columns == presets.preset_scan(segs).columns and empty.count() == 0


def test_long_guards_are_filed_under_long_grams(spark, monkeypatch):
    """Patterns that share all their trigrams fetch few lines; every way to find the filed grams gives the same hits."""
    from linesift.sources.presets import PATTERNS_SCHEMA

    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("ana", "nan", "日本", "é")) for _ in range(rng.randrange(1, 6)))
    rows = [("w", i, w, rf"\b{w}\b" if i % 2 else w, bool(i % 2)) for i in range(400) for w in [word()]]
    lines = [" ".join(word() for _ in range(rng.randrange(9))) for _ in range(200)]
    segs = segments_of(spark, [("f.txt", "\n".join(lines)), ("null.txt", None), ("empty.txt", "")])
    table = spark.createDataFrame(rows, PATTERNS_SCHEMA)
    filed = presets.pattern_index(presets.guarded_patterns(table)).collect()
    assert all(len(r.key) == (6 if len(r.guard) >= 6 else 3) and r.key in r.guard for r in filed) and {len(r.key) for r in filed} == {3, 6}
    want = sorted((n, o) for n, line in enumerate(lines, 1) for _, o, _, p, is_regex in rows if line and (re.search(p, line) if is_regex else p in line))
    for few, small in ((64, 200_000), (10**6, 10**6), (64, 20)):
        monkeypatch.setattr(presets, "FEW_KEYS", few)
        monkeypatch.setattr(presets, "SMALL_INDEX", small)
        assert sorted((r.line_number, r.ord) for r in presets.preset_scan_table(segs, table).collect()) == want
    assert len(want) > 400


def test_filed_grams_in_blocks(monkeypatch):
    """Lines that lie over several blocks, slices of a batch, null lines, keys that begin alike."""
    import pyarrow as pa

    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abé日") for _ in range(n))
    lines = [None if i % 17 == 0 else text(rng.randrange(60)) for i in range(80)]
    keys = sorted({text(3) for _ in range(20)} | {text(6) for _ in range(200)})
    held = lambda line, k: line is not None and k.encode()[: len(k)] in line.encode()
    for block in (5, 64, 1 << 20):
        monkeypatch.setattr(presets, "BLOCK", block)
        line, which = presets._key_finder(keys)(pa.array(lines).slice(3))
        want = [(i, j) for i, x in enumerate(lines[3:]) for j, k in enumerate(keys) if held(x, k)]
        assert [*zip(line.tolist(), which.tolist(), strict=True)] == want and want


def test_presets_load(spark, tmp_path):
    df = presets_frame(spark)
    assert df.count() == 21 and df.select("category").distinct().count() == 6
    assert df.where("is_regex").count() == 21
    assert by_label("Email Address")[1] is True and by_label("nope") == ("", False)
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert preset_list(str(bad)) == [] and presets_frame(spark, str(bad)).count() == 0
    assert presets_frame(spark, str(tmp_path / "missing.json")).count() == 0
    good = tmp_path / "presets.json"
    write_presets_json(str(good))
    assert preset_list(good.as_uri()) == preset_list() and presets_frame(spark, good.as_uri()).count() == 21
    from_file = sorted(tuple(r) for r in presets_frame(spark, str(good)).collect())
    assert from_file == sorted(tuple(r) for r in df.collect()) and preset_list(str(good)) == preset_list()


def test_preset_scan_matches_python_re(spark):
    segs = segments_of(spark, [("f.txt", INLINE)])
    got = sorted((r.line_number, r.label) for r in presets.preset_scan(segs).collect())
    want = []
    for i, line in enumerate(io.StringIO(INLINE, newline=None), 1):
        for _c, _o, label, pattern, _r in preset_list():
            if re.search(pattern, line):
                want.append((i, label))
    assert got == sorted(want)
    assert {label for _, label in got} == {p[2] for p in preset_list()}  # every preset hits something here
    table = sorted((r.line_number, r.label) for r in presets.preset_scan_table(segs, presets_frame(spark)).collect())
    assert table == got


def test_history_cap_and_dedup(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), f"keyword_{i}", "/dir", False) for i in range(6)]
    df = spark.createDataFrame(rows, "ts timestamp, keyword string, directory string, is_regex boolean")
    out = [r.keyword for r in history.search_history(df, cap=5).collect()]
    assert out == ["keyword_5", "keyword_4", "keyword_3", "keyword_2", "keyword_1"]
    twice = spark.createDataFrame([(t0, "k", "/d", True), (t0 + dt.timedelta(1), "k", "/d", True)],
                                  "ts timestamp, keyword string, directory string, is_regex boolean")
    assert history.search_history(twice).count() == 1
