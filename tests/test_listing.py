"""Listing from a frontier of directories: every entry once, directories that can't be opened as errors."""

import os

import pytest

from linesift.plans.search import search_directory
from linesift.sources import files


def write(root, rel, data="x"):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(data)


NAMES = [f"d{i}/e{j}/.f{k}" for i in range(4) for j in range(3) for k in range(3)] + ["top.txt", ".hidden/_x/y", "deep/" + "a/" * 12 + "z.txt"]


@pytest.mark.parametrize("limit,most", [(0, 1), (0, 7), (5, 10), (10, 10_000), (10_000, 1)])
def test_levels_hand_on_what_is_left(spark, tmp_path, limit, most):
    for rel in [*NAMES, "skip/x.txt", "d1/skip/y.txt"]:
        write(tmp_path, rel)
    found, errors = files._tree(spark, f"file:{tmp_path}", frozenset(["skip"]), limit, most)
    assert sorted(r.path for r in found.collect()) == sorted(f"file:{tmp_path}/{n}" for n in NAMES)
    assert errors.count() == 0


def test_entries_of_a_store(tmp_path, monkeypatch):
    """The listing through ``pyarrow.fs``, as for object stores: hidden names, sizes, times, no recursion."""
    for rel in (".env", "_x", "a b#?.txt", "sub/.git/config", "skip/z"):
        write(tmp_path, rel, "xyz")
    local = files._open
    monkeypatch.setattr(files, "_open", lambda uri: local(uri.replace("store://bucket", f"file:{tmp_path}")))
    got = sorted(files._entries("store://bucket", frozenset(["skip"])))
    assert [(e[0], e[1], e[2]) for e in got] == [("directory", "store://bucket/sub", None)] + [("file", f"store://bucket/{n}", 3) for n in (".env", "_x", "a b#?.txt")]
    assert all(e[3] > 10**15 for e in got if e[0] == "file")
    (error,) = files._entries("store://bucket/none", frozenset())
    assert error[:2] == ("error", "store://bucket/none") and "Error listing" in error[4]


def test_directories_that_cannot_be_opened(spark, tmp_path, monkeypatch):
    for rel in ("ok/a.txt", "locked/b.txt"):
        write(tmp_path, rel, "needle\n")
    scandir = os.scandir

    def guarded(path):
        if str(path).endswith("locked"):
            raise PermissionError(13, "Permission denied", str(path))
        return scandir(path)

    monkeypatch.setattr(os, "scandir", guarded)
    res = search_directory(spark, str(tmp_path), "needle")
    assert [r.file_path for r in res.hits.collect()] == ["ok/a.txt"]
    (error,) = res.errors.collect()
    assert (error.file_path, error.stage) == ("locked", "list") and "Permission denied" in error.message
    assert res.summary.first().errors == 1


def test_tasks_report_lost_directories_and_fail_without_the_root(tmp_path):
    import pyarrow as pa

    write(tmp_path, "a/x.txt")
    given = lambda *names: iter([pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}/{n}" for n in names]})])
    rows = [r for b in files._walk(given("a", "lost"), frozenset(), f"file:{tmp_path}") for r in b.to_pylist()]
    assert sorted((r["kind"], os.path.basename(r["path"])) for r in rows) == [("error", "lost"), ("file", "x.txt")]
    with pytest.raises(FileNotFoundError, match="does not see"):
        list(files._walk(given("a"), frozenset(), f"file:{tmp_path}/nothing"))
