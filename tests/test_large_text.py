"""Large files split across tasks keep exact line numbers and terminators."""

import io

from pyspark.sql import functions as F

from linesift.operators.grep import grep
from linesift.sources.files import list_files
from linesift.sources.large_text import large_file_lines, large_file_segments


def test_split_file_line_numbers(spark, tmp_path):
    body = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(1, 40001)) + "mixed\r\nends\rlast"
    (tmp_path / "big.txt").write_bytes(body.encode("utf-8"))
    (tmp_path / "small.txt").write_text("a\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))  # force many splits per file
    try:
        listing = list_files(spark, str(tmp_path))
        rows = large_file_lines(spark, listing).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r.file_path, []).append((r.line_number, r.raw))
    for name, text in (("big.txt", body), ("small.txt", "a\nb\n")):
        want = list(enumerate(io.StringIO(text, newline=None), 1))
        assert sorted(got[name]) == want, name
    segs = large_file_segments(spark, list_files(spark, str(tmp_path)))
    hit = grep(segs, r"line 39999\b", regex=True).select("file_path", "line_number").collect()
    assert [(h.file_path, h.line_number) for h in hit] == [("big.txt", 39999)]
    assert segs.where(F.col("raw").endswith("\n")).count() == 40002 + 2  # all but big.txt's last line


def test_scan_listing_routes_large_files(spark, tmp_path):
    from linesift.plans.search import scan_listing

    (tmp_path / "big.log").write_text("".join(f"row {i}\n" for i in range(1, 5001)) + "needle here\n")
    (tmp_path / "small.txt").write_text("needle\n")
    segs, errors = scan_listing(list_files(spark, str(tmp_path)), large_file_bytes=1000)
    got = sorted((h.file_path, h.line_number) for h in grep(segs, "needle").collect())
    assert got == [("big.log", 5001), ("small.txt", 1)] and errors.count() == 0


def test_large_binary_files_are_skipped(spark, tmp_path):
    (tmp_path / "data.bin").write_bytes(b"needle\x00" + b"x" * 5000)
    (tmp_path / "log.txt").write_text("needle\n" * 3)
    got = sorted((r.file_path, r.line_number) for r in large_file_lines(spark, list_files(spark, str(tmp_path))).collect())
    assert got == [("log.txt", 1), ("log.txt", 2), ("log.txt", 3)]
