"""The reference's engine tests, replayed through ``search_directory`` on an equivalent directory.

Same shapes as the reference's fixture (UTF-8 and CP932 text, a binary file,
minimal Word/Excel/PowerPoint packages), own texts; same expectations.
"""

import zipfile

import pytest

from linesift.plans.search import search_directory
from linesift.sources.office_writer import A_NS, P_NS, R_NS, REL_NS, S_NS, W_NS


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts:
            z.writestr(name, body)


def _xlsx(path, strings, cells):
    sst = "".join(f"<si><t>{s}</t></si>" for s in strings)
    rows = "".join(f'<row r="{i + 1}"><c r="{ref}" t="s"><v>{idx}</v></c></row>' for i, (ref, idx) in enumerate(cells))
    _zip(path, [
        ("xl/sharedStrings.xml", f'<sst xmlns="{S_NS}">{sst}</sst>'),
        ("xl/workbook.xml", f'<workbook xmlns="{S_NS}" xmlns:r="{R_NS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{REL_NS}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{S_NS}"><sheetData>{rows}</sheetData></worksheet>'),
    ])


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "sample_utf8.txt").write_text("Hello World\n日本語のテスト行です\nPython search", encoding="utf-8")
    (tmp_path / "sample_cp932.txt").write_bytes("Shift-JIS のテスト行\n検索する語はここ".encode("cp932"))
    (tmp_path / "sample.bin").write_bytes(b"\xff\xfe\xfd\x00\x01\x02")
    for ext in (".docx", ".docm"):
        body = f"<w:body><w:p><w:r><w:t>A Word {ext} paragraph</w:t></w:r></w:p></w:body>"
        _zip(tmp_path / f"sample{ext}", [("word/document.xml", f'<w:document xmlns:w="{W_NS}">{body}</w:document>')])
    _xlsx(tmp_path / "sample.xlsx", ["Excel cell to find"], [("A1", 0)])
    for ext in (".xlsx", ".xlsm"):  # four rows that all name cell A1, two of them hold Target
        _xlsx(tmp_path / f"many{ext}", ["Apple", "Banana Target", "Cherry", "Date Target"], [("A1", i) for i in range(4)])
    for ext in (".pptx", ".pptm"):
        slide = f"<p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>A Slide {ext}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld>"
        _zip(tmp_path / f"deck{ext}", [("ppt/slides/slide1.xml", f'<p:sld xmlns:p="{P_NS}" xmlns:a="{A_NS}">{slide}</p:sld>')])
    return tmp_path


def hits(spark, root, text, **opts):
    res = search_directory(spark, str(root), text, **opts)
    return [(h.file_path, h.line_number, h.location_display, h.line_content) for h in res.hits.collect()], res


def test_basic_search(spark, tree):
    got, _ = hits(spark, tree, "Python")
    assert got == [("sample_utf8.txt", 3, "", "Python search")]


def test_multilingual_search(spark, tree):
    got, _ = hits(spark, tree, "テスト")
    assert sorted(p for p, *_ in got) == ["sample_cp932.txt", "sample_utf8.txt"]


def test_regex_search(spark, tree):
    got, _ = hits(spark, tree, r"World|search", regex_mode=True)
    assert len(got) == 2


def test_progress_summary(spark, tree):
    _, res = hits(spark, tree, "test")
    s = res.summary.collect()[0]
    assert s.files == 10 and s.files_with_hits <= s.files


def test_stop_after_first_hit(spark, tree):
    from linesift.operators.output import first_n_hits

    res = search_directory(spark, str(tree), "テスト")
    assert first_n_hits(res.hits, 1).count() == 1


def test_office_search(spark, tree):
    got, _ = hits(spark, tree, "Word")
    assert {p for p, *_ in got} == {"sample.docx", "sample.docm"}
    got, _ = hits(spark, tree, "Excel")
    assert [(p, loc, c) for p, _, loc, c in got] == [("sample.xlsx", "Sheet1!A1", "Excel cell to find")]
    got, _ = hits(spark, tree, "Target")
    assert sorted(p for p, *_ in got) == ["many.xlsm", "many.xlsm", "many.xlsx", "many.xlsx"]
    got, _ = hits(spark, tree, "Slide")
    assert {p for p, *_ in got} == {"deck.pptx", "deck.pptm"}


def test_exclude_extensions_and_patterns(spark, tmp_path):
    for name in ("keep.txt", "ignore.log", "old.bak"):
        (tmp_path / name).write_text("FindMe here", encoding="utf-8")
    got, _ = hits(spark, tmp_path, "FindMe", exclude_exts=[".log"])
    assert sorted(p for p, *_ in got) == ["keep.txt", "old.bak"]
    got, _ = hits(spark, tmp_path, "FindMe", exclude_file_patterns=["*.bak"])
    assert sorted(p for p, *_ in got) == ["ignore.log", "keep.txt"]


def test_error_output_for_broken_package(spark, tmp_path):
    (tmp_path / "broken.docx").write_text("no zip inside", encoding="utf-8")
    _, res = hits(spark, tmp_path, "dummy")
    errors = res.errors.collect()
    assert len(errors) == 1 and "parsing DOCX" in errors[0].message
