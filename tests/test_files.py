"""Directory scans: exclusions, binary skip, encodings, broken Office files (reference fixtures)."""

from linesift.operators.grep import grep
from linesift.operators.prune import Exclusions
from linesift.plans.search import scan_listing
from linesift.sources.files import list_files
from linesift.sources.office_writer import docx_bytes


def write(root, rel, data):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))


def hits(spark, root, needle, ex=Exclusions(), **opts):
    segs, errors = scan_listing(list_files(spark, str(root)), ex)
    rows = grep(segs, needle, **opts).select("file_path", "line_number", "location_display").collect()
    return sorted(tuple(r) for r in rows), sorted(tuple(r) for r in errors.collect())


def test_deep_directory_exclusion(spark, tmp_path):
    for rel in ["target.txt", "subdir/target.txt", "subdir/node_modules/ignored.txt", "binary/target.txt"]:
        write(tmp_path, rel, "a target line\n")
    got, _ = hits(spark, tmp_path, "target", Exclusions.of(dirs=["node_modules", "bin"]))
    assert [p for p, _, _ in got] == ["binary/target.txt", "subdir/target.txt", "target.txt"]


def test_extension_and_glob_exclusion(spark, tmp_path):
    for rel in ["keep.txt", "ignore.log", "old.bak", "Upper.LOG"]:
        write(tmp_path, rel, "needle\n")
    got, _ = hits(spark, tmp_path, "needle", Exclusions.of(exts=["LOG"], globs=["*.bak"]))
    assert [p for p, _, _ in got] == ["keep.txt"]


def test_binary_skipped_and_cp932_found(spark, tmp_path):
    write(tmp_path, "bin.dat", bytes([0xFF, 0xFE, 0xFD, 0x00, 0x01, 0x02]))
    write(tmp_path, "nul_late.txt", bytes([0xE3, 0x00, 0x41]) + "テスト".encode("utf-8"))
    write(tmp_path, "utf8.txt", "これはテストです\n")
    write(tmp_path, "sjis.txt", "テスト一行目\n二行目テスト\n".encode("cp932"))
    got, errors = hits(spark, tmp_path, "テスト")
    assert [(p, n) for p, n, _ in got] == [("sjis.txt", 1), ("sjis.txt", 2), ("utf8.txt", 1)]
    assert errors == []


def test_office_hits_and_broken_office(spark, tmp_path):
    write(tmp_path, "a.docx", docx_bytes("first line\nTarget here", "s", "l"))
    write(tmp_path, "b.docm", docx_bytes("Target too", "s", "l"))
    write(tmp_path, "broken.docx", "Target in a fake package\n")
    got, errors = hits(spark, tmp_path, "Target")
    assert ("a.docx", 0, "Body P.2") in got and ("b.docm", 0, "Body P.1") in got
    assert ("broken.docx", 1, "") in got  # reported, then read as text
    assert len(errors) == 1 and errors[0][0] == "broken.docx" and "DOCX" in errors[0][2]


def test_listing_reads_no_bytes(spark, tmp_path):
    write(tmp_path, "x/y.txt", "abc")
    listing = list_files(spark, str(tmp_path))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    row = listing.collect()[0]
    assert (row.file_path, row.base_name, row.ext, list(row.dirs), row.length) == ("x/y.txt", "y.txt", ".txt", ["x"], 3)


def test_files_from_reads_dotfiles_and_hits_sink(spark, tmp_path):
    from linesift.operators.output import write_hits
    from linesift.plans.search import scan
    from linesift.sources.files import files_from

    write(tmp_path, ".env", "SECRET=needle\n")
    write(tmp_path, ".git/config", "needle\n")
    listed = list_files(spark, str(tmp_path))
    assert sorted(r.file_path for r in listed.collect()) == [".env", ".git/config"]
    paths = spark.createDataFrame([(str(tmp_path / ".env"), ".env"), (str(tmp_path / ".git/config"), ".git/config"),
                                   (str(tmp_path / "missing.txt"), "missing.txt")], "path string, file_path string")
    loaded = files_from(paths)
    assert loaded.where("error IS NOT NULL").count() == 1
    segs, _ = scan(loaded.where("error IS NULL").select("file_path", "content"))
    hits = grep(segs, "needle")
    out = str(tmp_path / "out")
    write_hits(hits, out)
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == [".env", ".git/config"]


def test_search_directory_like_the_reference(spark, tmp_path):
    import pytest

    from linesift.plans.search import search_directory

    write(tmp_path, "root.txt", "Hello World\nsearch me\nPython Grep")
    write(tmp_path, "node_modules/x.txt", "search\n")
    write(tmp_path, "bad.docx", "search in a broken package\n")
    res = search_directory(spark, str(tmp_path), r"World|search", regex_mode=True, exclude_dirs=["node_modules"])
    got = sorted((h.file_path, h.line_number) for h in res.hits.collect())
    assert got == [("bad.docx", 1), ("root.txt", 1), ("root.txt", 2)]
    s = res.summary.collect()[0]
    assert (s.files, s.hits, s.files_with_hits, s.errors) == (2, 3, 2, 1)
    with pytest.raises(ValueError, match="Invalid regular expression"):
        search_directory(spark, str(tmp_path), "(", regex_mode=True)


def test_root_name_never_matches_an_exclusion(spark, tmp_path):
    root = tmp_path / "node_modules"
    write(root, "a.txt", "needle\n")
    write(root, "node_modules/b.txt", "needle\n")
    write(root, "bin/c.txt", "needle\n")
    write(root, "binary/d.txt", "needle\n")
    got, _ = hits(spark, root, "needle", Exclusions.of(dirs=["node_modules", "bin"]))
    assert [p for p, _, _ in got] == ["a.txt", "binary/d.txt"]  # the root itself and "binary" are not excluded


def test_read_errors_without_reading(spark, tmp_path):
    from linesift.sources.files import read_errors

    write(tmp_path, "ok.txt", "fine\n")
    listing = spark.createDataFrame(
        [(str(tmp_path / "ok.txt"), "ok.txt"), (str(tmp_path / "gone.txt"), "gone.txt")], "path string, file_path string"
    )
    errs = read_errors(listing).collect()
    assert [(e.file_path, e.stage) for e in errs] == [("gone.txt", "read")] and "gone.txt" in errs[0].message


NAMES = [".env", ".git/x", "_z.txt", "_u/y.txt", "C#.txt", "what?.txt", "100%25.txt", "a b.txt", "a+b.txt", "log[1].txt", "deep/a/b/c/d.txt"]


def test_every_name_is_searched_from_a_relative_root(spark, tmp_path, monkeypatch):
    import os

    from linesift.plans.search import search_directory

    root = tmp_path / "tmp" / "tree"
    for rel in [*NAMES, "tmp/out.txt"]:
        write(root, rel, "needle\n")
    os.symlink(root, root / "circle")
    monkeypatch.chdir(tmp_path / "tmp")
    res = search_directory(spark, "./tree", "needle", exclude_dirs=["tmp"])
    assert sorted(r.file_path for r in res.hits.collect()) == sorted(NAMES) and res.errors.count() == 0


def test_tasks_walk_what_the_driver_leaves(spark, tmp_path):
    from linesift.sources.files import _walked

    for rel in [*NAMES, "skip/z.txt"]:
        write(tmp_path, rel, "x")
    whole = sorted(str(tmp_path / n) for n in NAMES)
    for limit in (0, 9, 12, 100):
        got = _walked(spark, str(tmp_path), frozenset(["skip"]), limit).collect()
        assert sorted(r.path.removeprefix("file:") for r in got) == whole and {r.length for r in got} == {1}


def test_names_of_large_files(spark, tmp_path):
    for rel in NAMES:
        write(tmp_path, rel, "one\nneedle\n")
    segs, errors = scan_listing(list_files(spark, str(tmp_path)), large_file_bytes=1)
    rows = grep(segs, "needle").collect()
    assert sorted((r.file_path, r.line_number) for r in rows) == sorted((n, 2) for n in NAMES) and errors.count() == 0


def test_search_directory_parsers_and_encodings(spark, tmp_path):
    from linesift.plans.search import search_directory

    write(tmp_path, "a.csv", "x,1\nneedle,2")
    write(tmp_path, "empty.csv", "skip\nneedle")
    write(tmp_path, "bad.csv", "fail\nneedle")
    write(tmp_path, "l.txt", "needle \xe9\n".encode("latin-1"))

    def rows(path, content):
        if content.startswith(b"fail"):
            raise ValueError("no table")
        return [] if content.startswith(b"skip") else [{"text": x, "location": f"row {i}"} for i, x in enumerate(content.decode().split("\n"), 1)]

    res = search_directory(spark, str(tmp_path), "needle", parsers={"CSV": rows}, encodings=["utf-8", "latin-1"])
    got = sorted((r.file_path, r.line_number, r.location_display, r.line_content) for r in res.hits.collect())
    assert got == [("a.csv", 0, "row 2", "needle,2"), ("bad.csv", 2, "", "needle"), ("empty.csv", 2, "", "needle"), ("l.txt", 1, "", "needle \xe9")]
    assert [(e.file_path, e.stage) for e in res.errors.collect()] == [("bad.csv", "extract")]
