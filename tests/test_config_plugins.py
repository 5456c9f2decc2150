"""Exclusion config loading, list normalising, history log, lenient decoding, parser plug-ins."""

import datetime as dt
import json

from pyspark.sql import functions as F

from linesift.operators import encoding as enc
from linesift.operators.grep import grep
from linesift.operators.history import append_entry, read_history
from linesift.operators.plugins import plugin_segments, register_parser
from linesift.operators.prune import Exclusions, normalize_extensions, normalize_list, normalize_list_col, split_comma_list, toggle_groups
from linesift.sources.config import load_exclusions


def test_list_normalising(spark):
    assert split_comma_list(" .git,  node_modules, , bin ") == [".git", "node_modules", "bin"]
    assert normalize_extensions(["TXT", "md", ".Pdf"]) == [".txt", ".md", ".pdf"]
    assert normalize_list("one") == ["one"] and normalize_list(3) == []
    df = spark.createDataFrame([([" TXT", "", ".Md "],)], "x array<string>")
    assert df.select(normalize_list_col(F.col("x"), extensions=True)).collect()[0][0] == [".txt", ".md"]
    assert toggle_groups(["log"], ["archives"], []) == [".log", ".zip", ".tar", ".gz", ".rar", ".7z"]
    assert Exclusions.of(dirs=["a"]).effective(dirs=[]).dirs == ()


def test_load_exclusions(spark, tmp_path):
    p = tmp_path / "exclude.json"
    p.write_text(json.dumps({"exclude_dirs": [" .git", "", "node_modules"], "exclude_exts": "LOG"}))
    ex = load_exclusions(spark, str(p))
    assert ex.dirs == (".git", "node_modules") and ex.exts == (".log",)
    assert load_exclusions(spark, p.as_uri()) == ex
    bad = tmp_path / "bad.json"
    bad.write_text("[1, 2")
    assert load_exclusions(spark, str(bad)) == Exclusions()
    assert load_exclusions(spark, str(tmp_path / "none.json")) == Exclusions()


def test_history_log(spark, tmp_path):
    path = str(tmp_path / "history")
    t0 = dt.datetime(2024, 1, 1)
    for i, kw in enumerate(["a", "b", "a", "c"]):
        append_entry(spark, path, kw, "/d", False, ts=t0 + dt.timedelta(minutes=i))
    assert [r.keyword for r in read_history(spark, path).collect()] == ["c", "a", "b"]
    assert [r.keyword for r in read_history(spark, path, cap=2).collect()] == ["c", "a"]


def test_lenient_decode(spark):
    data = [("u", bytearray("ok é".encode())), ("s", bytearray("テスト".encode("cp932"))), ("e", bytearray(b"")),
            ("x", bytearray(b"\xff\xfe\xfa\x81"))]
    rows = {r.path: r for r in enc.decode_lenient(spark.createDataFrame(data, "path string, content binary")).collect()}
    assert rows["u"].text == "ok é" and rows["u"].encoding_used == "utf-8"
    assert rows["s"].text == "テスト" and rows["s"].success
    assert rows["e"].text == "" and rows["e"].success
    assert rows["x"].success and rows["x"].text  # never fails


def test_parser_plugin(spark):
    def csv_parser(path, content):
        return [{"text": line, "location": f"row {i}", "metadata": {"n": i}}
                for i, line in enumerate(content.decode().splitlines(), 1)]

    register_parser(".csv", csv_parser)
    files = spark.createDataFrame([("a.csv", bytearray(b"x,1\nneedle,2")), ("b.txt", bytearray(b"needle"))],
                                  "file_path string, content binary")
    segs, errs = plugin_segments(files)
    hits = grep(segs, "needle").collect()
    assert [(h.file_path, h.location_display, h.metadata["n"]) for h in hits] == [("a.csv", "row 2", "2")]
    assert errs.count() == 0


def test_scan_dispatch_with_plugin(spark):
    from linesift.plans.search import scan

    files = spark.createDataFrame([("a.csv", bytearray(b"needle,1")), ("b.txt", bytearray(b"needle\n"))],
                                  "file_path string, content binary")
    segs, errs = scan(files, parsers={".csv": lambda p, c: [{"text": c.decode(), "location": "row 1"}]})
    got = sorted((h.file_path, h.location_display) for h in grep(segs, "needle").collect())
    assert got == [("a.csv", "row 1"), ("b.txt", "")] and errs.count() == 0
