"""Text files by byte ranges: counts, verdicts, lines and errors don't depend on where files are cut."""

import io
import os
import random

import pytest

from linesift.operators import encoding as enc
from linesift.operators.grep import compile_search, grep
from linesift.operators.output import search_outcome, write_outcome
from linesift.plans.search import scan_listing, scan_parts, search_directory
from linesift.sources import ranges
from linesift.sources.files import list_files

CODECS = ["utf-8", "cp932", "shift_jis", "euc_jp", "iso-2022-jp", "utf-16", "utf-8-sig", "gb18030", "big5", "euc-kr", "latin-1", "utf-16-be"]
# Line ends alone and inside wide characters, marks and vowels that join the character before, characters beyond 16 bits.
PARTS = ["テスト一行目 ", "abc ", "日本語", "ｶﾅ", "\n", "\r\n", "\r", "が", "ਊ", "ഊ", "਀", "é", "é", "가", "\U0001f389"]


def model(content, encoding):
    return list(io.StringIO(content.decode(encoding), newline=None))


@pytest.mark.parametrize("size", [7, 16, 50, 1000])
def test_ranges_add_up_to_the_file(tmp_path, size):
    rng = random.Random(size)
    for i in range(150):
        text = "".join(rng.choice([*PARTS, "x" * rng.randrange(30)]) for _ in range(rng.randrange(50)))
        content = text.encode(rng.choice(CODECS), "ignore") + b"\xff" * (rng.random() < 0.1)
        path = tmp_path / f"f{i}"
        path.write_bytes(content)
        whole = {x["ord"]: x for x in enc._facts(content, CODECS)}
        bounds = [(k * size, min(len(content), (k + 1) * size)) for k in range(max(1, -(-len(content) // size)))]
        with ranges.Bytes(str(path), len(content)) as f:
            state, entries, found = ranges.ESCAPES[0], [], []
            for k, (a, b) in enumerate(bounds):
                facts, escape = ranges.range_facts(f, k, a, b, CODECS)
                found.append([next((x for x in one if x["entry"] in (None, state)), None) for one in facts])
                entries.append(state)
                state = escape or state
            for j, codec in enumerate(CODECS):
                column = [row[j] for row in found]
                assert all(column) == (j in whole), (i, codec)
                if j not in whole:
                    continue
                total = {c: None if any(x[c] is None for x in column) else sum(x[c] for x in column) for c in ("n", "script2", "nfc", "again")}
                assert total | {"ascii": all(x["ascii"] for x in column)} == {c: whole[j][c] for c in ("n", "script2", "nfc", "again", "ascii")}, (i, codec)
                lines = []
                for (a, b), entry, x in zip(bounds, entries, column, strict=True):
                    own = list(io.StringIO(ranges.range_text(f, a, b, codec, entry), newline=None))
                    assert len(own) == x["lines"], (i, codec)
                    lines += own
                assert lines == model(content, codec), (i, codec)


LINES = "".join(f"行番号{i}のテスト、日本語の文章です。ひらがなとカタカナ\n" for i in range(1, 400))
WIDE = ("全角文字" * 150 + "\n" + LINES).encode("utf-16")  # no NUL byte among the first 1,024: the first line end comes later
FILES = {
    "cp932.txt": (LINES.encode("cp932"), "cp932"),
    "eucjp.txt": (LINES.encode("euc_jp"), "euc_jp"),
    "utf16.txt": (WIDE, "utf-16"),
    "jis.txt": (LINES.encode("iso-2022-jp"), "iso-2022-jp"),
    "utf8.txt": (LINES.encode(), "utf-8"),
    "bom.txt": (LINES.encode("utf-8-sig"), "utf-8-sig"),
    "crlf.txt": (LINES.replace("\n", "\r\n").encode("cp932"), "cp932"),
    "old.txt": (LINES.replace("\n", "\r").encode(), "utf-8"),
    "one.txt": (("テスト" * 3000).encode(), "utf-8"),
    "empty.txt": (b"", "utf-8"),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, (content, _) in FILES.items():
        (root / name).write_bytes(content)
    (root / "binary.txt").write_bytes(b"\x00" + LINES.encode())
    (root / "odd.txt").write_bytes(b"\x81\n" * 1500 + b"\x81")  # no candidate decodes it
    (root / "gone.txt").symlink_to(root / "nowhere")
    return root


@pytest.mark.parametrize("size", [1 << 10, 1 << 30, None])
def test_hits_are_the_same_for_ranges_of_any_size(spark, tree, size):
    candidates = [*enc.ENGINE_ENCODINGS]
    parts = scan_parts(list_files(spark, str(tree)), encodings=candidates, range_bytes=size)
    if size == 1 << 10:
        per_file = {r["file_path"]: r["count"] for r in parts.texts.groupBy("file_path").count().collect()}
        assert per_file["cp932.txt"] > 20 and per_file["utf16.txt"] > 20 and per_file["empty.txt"] == 1
    chosen = {r["file_path"]: r["encoding"] for r in parts.texts.where("encoding is not null").select("file_path", "encoding").distinct().collect()}
    whole = {r.path: r.encoding for r in enc.decode(spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in FILES.items()], "path string, content binary"), candidates).collect()}
    assert chosen == whole
    got = sorted((r.file_path, r.line_number, r.line_content) for r in grep(parts.all_segments(), "テスト").collect())
    want = sorted((n, i, x.rstrip()) for n, (c, _) in FILES.items() for i, x in enumerate(model(c, whole[n]), 1) if "テスト" in x)
    assert got == want and {n for n, *_ in got} >= {"cp932.txt", "eucjp.txt", "utf16.txt", "utf8.txt"}  # seven-bit JIS is valid UTF-8
    assert sorted((e.file_path, e.stage) for e in parts.all_errors().collect()) == [("gone.txt", "read"), ("odd.txt", "decode")]


def test_encodings_that_cannot_be_cut(spark, tmp_path):
    text = "a line\nnexté\n" * 50
    (tmp_path / "u7.txt").write_bytes(b"+2AA-" + b"x\n" * 40)  # not valid in any: an error, and not a wrong cut
    (tmp_path / "u32.txt").write_bytes(text.encode("cp500"))
    assert ranges.kind("utf-7") == ranges.kind("cp500") == ranges.kind("utf-32") == "whole" and ranges.kind("nope") is None
    assert ranges.kind("latin-1") == ranges.kind("cp1252") == ranges.kind("GBK") == "bytes"
    segs, errors = scan_listing(list_files(spark, str(tmp_path)), encodings=["cp500"], large_file_bytes=64)
    assert segs.where("file_path = 'u32.txt'").count() == len(text.encode("cp500").decode("cp500").splitlines()) and errors.count() == 0


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_a_file_is_searched_or_an_error(spark, tmp_path, size):
    """A file that ends before its listed length fails while it is read: an error, and none of its lines."""
    for name in ("short.txt", "good.txt"):
        (tmp_path / name).write_text("needle\n" * 100)
    listing = list_files(spark, str(tmp_path))
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    (tmp_path / "short.txt").write_text("needle\n" * 20)
    parts = scan_parts(listing, range_bytes=size)
    lines, errors = parts.all_segments().groupBy("file_path").count().collect(), parts.all_errors().collect()
    searched, failed = {r[0] for r in lines}, {r.file_path for r in errors}
    assert searched | failed == {"short.txt", "good.txt"} and not searched & failed
    if size == 100:
        assert failed == {"short.txt"} and dict(lines) == {"good.txt": 100} and "listed with 700" in errors[0].message


def test_lines_longer_than_a_row_are_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "LINE_BYTES", 200_000)
    path = tmp_path / "long.txt"
    path.write_bytes(b"x" * 600_000)
    with ranges.Bytes(str(path), 600_000) as f:
        with pytest.raises(ValueError, match="longer than"):
            f.line_start(1000)


@pytest.mark.parametrize("size", [1 << 10, None])
def test_outcome_is_written_from_one_reading(spark, tree, tmp_path, size):
    search = compile_search("テスト")
    parts = scan_parts(list_files(spark, str(tree)), range_bytes=size)
    out = write_outcome(search_outcome(parts, search), str(tmp_path / "out"))
    key = lambda r: (r.file_path, r.line_number, r.line_content)
    assert sorted(map(key, out.hits.collect())) == sorted(map(key, grep(parts.all_segments(), search).collect()))
    errors = [("gone.txt", "read"), ("odd.txt", "decode")]
    assert sorted((r.file_path, r.stage) for r in out.errors.collect()) == errors
    assert out.metrics == {"hits": out.hits.count(), "segments": parts.all_segments().count(), "skipped": 1, "errors": 2}
    per = {r.file_path: r for r in out.per_file.collect()}
    assert set(per) == {*FILES, "binary.txt", "odd.txt", "gone.txt"}
    assert per["binary.txt"].skipped and per["odd.txt"].failed and per["utf8.txt"].segments == 399 and not per["utf8.txt"].failed
    if size is None:  # one Python step reads, another decodes what is not UTF-8
        plan = search_outcome(parts, search)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_search_result_write_with_packages(spark, tmp_path):
    from linesift.sources.office_writer import docx_bytes

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.docx").write_bytes(docx_bytes("x\nneedle in word", "s", "l"))
    (root / "broken.docx").write_text("needle in a broken package\n" * 3)
    (root / "b.txt").write_text("needle\nother\n")
    os.symlink(root / "none.xlsx", root / "lost.xlsx")
    res = search_directory(spark, str(root), "needle", range_bytes=20)
    out = res.write(str(tmp_path / "out"))
    assert sorted((r.file_path, r.line_number, r.location_display) for r in out.hits.collect()) == [("a.docx", 0, "Body P.2"), ("b.txt", 1, ""), ("broken.docx", 1, ""), ("broken.docx", 2, ""), ("broken.docx", 3, "")]
    assert sorted((r.file_path, r.stage) for r in out.errors.collect()) == [("broken.docx", "extract"), ("lost.xlsx", "read")]
    assert out.metrics["hits"] == 5 and out.metrics["errors"] == 2
    assert sorted((e.file_path, e.stage) for e in res.errors.collect()) == [("broken.docx", "extract"), ("lost.xlsx", "read")]


def test_tasks_follow_the_ranges_and_not_the_files(spark, tmp_path):
    """500 files of two ranges each are a few tasks' work, and their rows come together; long ranges keep tasks of their own."""
    for i in range(500):
        (tmp_path / f"f{i}.txt").write_text(f"line {i}\n" * 20)
    texts = scan_parts(list_files(spark, str(tmp_path)), encodings=("utf-8", "latin-1"), range_bytes=100).texts
    slots = spark.sparkContext.defaultParallelism
    assert texts.rdd.getNumPartitions() <= 3 * slots
    lines = ranges.text_lines(texts)
    assert lines.count() == 10_000 and lines.where("line_number = 20").count() == 500
    assert ranges.range_tasks(spark, 50 * (300 << 20), 50, ranges.RANGE_BYTES) >= 50 * 300 // 64
