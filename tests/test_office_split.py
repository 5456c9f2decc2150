"""Packages alone with their path are read without staging or shuffle, and give what the others' joins and windows give."""

import io
import warnings
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_office import RELS, WB, _tree_of_packages, pkg, rows, sheet, slide, wdoc

import __spark_entry__ as E
from conftest import SF_SMALL
from linesift.operators import office
from linesift.operators.grep import grep
from linesift.plans import office_queries as OQ
from linesift.sources.office_writer import S_NS, docx_bytes, pptx_bytes, xlsx_bytes

NUMBERS = ["0", " 1 ", "+1", "-0", "-1", "1.0", "1_0", "٣", "1e0", "007", "--1", "", "+", "\u00a01", "99999999999999999999", "9223372036854775808", "x"]


def odd_workbook(target="worksheets/a.xml", strings="<si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si><si/>"):
    cells = "".join(f'<c r="A{i}" t="s"><v>{v}</v></c>' for i, v in enumerate(NUMBERS))
    return [
        ("xl/workbook.xml", WB.format('<sheet name="S" sheetId="1" r:id="r1"/><sheet name="T" sheetId="2" r:id="r1"/><sheet name="U" sheetId="3" r:id="r2"/>'
                                      '<sheet name="" sheetId="4" r:id="r2"/><sheet name="V" sheetId="5"/><sheet name="W" sheetId="6" r:id="r9"/>')),
        ("xl/_rels/workbook.xml.rels", RELS.format(f'<Relationship Id="r1" Target="/xl/worksheets/a.xml"/><Relationship Id="r1" Target="{target}"/>'
                                                   '<Relationship Id="r2" Target="worksheets/b.xml"/><Relationship Target="x"/><Relationship Id="" Target="y"/>')),
        ("xl/sharedStrings.xml", f'<sst xmlns="{S_NS}">{strings}</sst>'),
        ("xl/worksheets/a.xml", sheet(f'<row r="1">{cells}<c r="B1" t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c><c r="B2" t="inlineStr"/><c r="B3"/></row>')),
        ("xl/worksheets/b.xml", sheet('<row r="1"><c r="A1"><v>7</v></c><c r="B1" t="s"><v>2</v></c><c t="str"><v>no place</v></c></row>')),
    ]


def odd_packages(tmp_path):
    """Name, content."""
    listed, _ = _tree_of_packages(tmp_path)
    out = {name: (tmp_path / name).read_bytes() for _uri, name, _n in listed}
    out["odd.xlsx"] = pkg(odd_workbook())
    out["two.xlsx"] = pkg(odd_workbook("worksheets/b.xml"))
    out["cut_strings.xlsx"] = pkg(odd_workbook(strings="<si><t>zero</t></si><si><t>one</t></si><si><t>x</si>"))
    out["no_strings.xlsx"] = pkg([p for p in odd_workbook() if "shared" not in p[0]])
    out["no_rels.xlsx"] = pkg([p for p in odd_workbook() if "rels" not in p[0]])
    with warnings.catch_warnings():  # members of the same name
        warnings.simplefilter("ignore")
        out["twice.docx"] = pkg([("word/document.xml", wdoc("document", "x")), ("word/header1.xml", wdoc("hdr", "h")),
                                 ("word/document.xml", wdoc("document", "one", "", "two"))])
        out["twice.pptx"] = pkg([("ppt/slides/slide1.xml", slide(["a"])), ("ppt/notesSlides/notesSlide1.xml", slide(["n"], ["m"])),
                                 ("ppt/slides/slide1.xml", slide(["b"], ["\u2003", " "], ["c"])), ("ppt/notesSlides/notesSlide1.xml", slide(["n"], ["m"]))])
    out["order.pptx"] = pkg([("ppt/notesSlides/notesSlide2.xml", slide(["early"])), ("ppt/notesSlides/notesSlide3.xml", slide(["no slide"])),
                             ("ppt/slides/slide02.xml", slide(["\u00a0x\u2028"])), ("ppt/slides/slide2.xml", slide(["y"]))])
    out["dir.v2/Report.DOCM"] = docx_bytes("\n the end\n\n  \nlast", "s", "l")
    out["a.xlsx"], out["a.pptx"] = xlsx_bytes("the\n\n a<b", "s", "l", 3), pptx_bytes("the\n\nx\n \ny", "l")
    out["pkg.docx/notes"] = b"plain"
    return list(out.items())


def frame(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")


def seen(tokens, *columns):
    segments = office.office_segments(tokens).withColumn("metadata", F.to_json("metadata"))
    return rows(segments, "file_path", "ext", "raw", "line_number", "location_display", "metadata", *columns)


def test_own_rows_are_those_of_the_joins(spark, tmp_path):
    files = odd_packages(tmp_path)
    tokens, split = office.tokenize(frame(spark, files)), office.tokenize_split(frame(spark, files), None)
    assert seen(split) == seen(tokens)
    assert {r[0] for r in seen(split)} >= {"odd.xlsx", "two.xlsx", "twice.docx", "twice.pptx", "order.pptx", "dir.v2/Report.DOCM"}
    once = ~F.col("file_path").startswith("twice")
    ordered = lambda t: rows(office.office_segments(t).where(once), "file_path", "location_display", "raw", "seq")
    assert ordered(split) == ordered(tokens)
    assert rows(office.errors(split), "file_path", "stage", "message") == rows(office.errors(tokens), "file_path", "stage", "message")
    assert rows(office.unreadable_packages(split), "file_path", "content") == rows(office.unreadable_packages(tokens), "file_path", "content")
    few = [office.excel_cells(f, ["S7", "S9", "T"]) for f in (office.tokenize_split(frame(spark, files), None, ["S7", "S9", "T"]), office.tokenize(frame(spark, files), ["S7", "S9", "T"]))]
    assert rows(few[0], "file_path", "location_display", "raw") == rows(few[1], "file_path", "location_display", "raw") != []


def test_numbers_are_cast_as_in_sql(spark):
    values = [*NUMBERS, "9223372036854775807", "-9223372036854775808", "-9223372036854775809", "000000000000000000000012", "\t5\n", "5\x7f", "1 2", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").selectExpr("i", "try_cast(v AS BIGINT) AS n").orderBy("i")
    assert [office._long(v) for v in values] == [r.n for r in df.collect()]


@pytest.mark.parametrize("most", [office.MAX_SHARED, 0])
def test_shared_paths_are_put_together_as_before(spark, tmp_path, monkeypatch, most):
    """Packages that come twice, and others of one path, keep their rows; with too many of them all go that way."""
    monkeypatch.setattr(office, "MAX_SHARED", most)
    files = odd_packages(tmp_path)
    files += [f for f in files if f[0] in ("odd.xlsx", "s.pptx", "packed.docx")] + [("a.pptx", pptx_bytes("other\nthe", "k")), ("stored.docx", docx_bytes("x\ny", "s", "l"))]
    files = [f for f in files if not f[0].startswith("twice")]
    df = frame(spark, files)
    own, shared = office.split_by_path(df)
    assert own is None if most == 0 else own.count() == len(files) - 10
    assert shared.count() == (len(files) if most == 0 else 10)
    assert seen(office.tokenize_split(own, shared)) == seen(office.tokenize(df))


def test_office_grep_stages_and_shuffles_nothing(spark):
    """Before, all tokens of the three formats were shuffled and written again."""
    df = E.queries()["office_grep"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in p and "ExistingRDD" not in p and "Join" not in p, p
    assert df.count() > 0


def test_office_grep_of_documents_with_one_id(spark, tmp_path):
    texts = ["the first\n\nno\nand the last", "over the hill\nx", "none", "the <same>", "a\nb\nc\nd\n the e \n"]
    docs = [(i % 4, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = None
    for kind, extract in (("docx", office.word_paragraphs), ("xlsx", office.excel_cells), ("pptx", office.powerpoint_paragraphs)):
        segments = extract(OQ.tokens(spark, str(tmp_path), kind))
        want = segments if want is None else want.unionByName(segments)
    columns = ("file_path", "location_display", "line_content")
    got = rows(E.queries()["office_grep"](spark, str(tmp_path)), *columns)
    assert got == rows(grep(want, "the", whole_word=True), *columns) and {r[0].split(".")[0] for r in got} == {"src1/en/0", "src1/en/1", "src1/en/3"}


def test_strings_beyond_memory_and_bounded_batches(monkeypatch):
    monkeypatch.setattr(office, "CHARS_PER_BATCH", 2_000)
    lines = [f"línea {i} " + "ñ" * (i % 90) for i in range(900)]
    book = xlsx_bytes("\n".join(lines), "s", "l", 1)
    batch = pa.RecordBatch.from_pydict({"path": ["b.xlsx"] * 3, "content": [book] * 3})
    batches = list(office._own_batches(iter([batch]), None))
    assert max(b.nbytes for b in batches) < 60_000
    found = [r for b in batches for r in b.to_pylist() if r["name"] == "Lines" and r["ref"].startswith("A")]
    assert [r["text"] for r in found] == lines * 3
    strings = office._Strings()
    strings.add(["x" * 3_000])
    assert strings.file and strings.get(0) == "x" * 3_000 and strings.get(1) == strings.get(-1) == strings.get(None) == ""


def test_packages_are_zip_files():
    """Packages written member by member are what the ZIP library reads, short and long, and beyond 65,535 members."""
    from linesift.sources import office_writer as W

    for body in ("", "x", "é" * 300, "some words and more words " * 9_000):
        parts = [("[Content_Types].xml", "<a/>"), ("word/document.xml", body), ("word/styles.xml", body[::-1])]
        for data in (W._zip(parts), W._zip_long(parts)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                assert z.testzip() is None and [(i.filename, z.read(i).decode()) for i in z.infolist()] == parts
                assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED}
    many = [(f"m{i}", "") for i in range(65_540)]
    assert len(zipfile.ZipFile(io.BytesIO(W._zip(many))).namelist()) == 65_540


def test_workbook_parts_are_read_as_by_the_zip_library(monkeypatch):
    """Read at once, a workbook's own parts give what the library gives, also where it reports an error."""
    book = xlsx_bytes("the\nend", "s", "l", 7)
    at = book.index(b"xl/workbook.xml")  # the local header's name
    end = at + len(b"xl/workbook.xml")
    cases = {"sound": book, "name": book[:at] + b"xl/workb00k.xml" + book[end:], "packed": book[:end + 4] + b"\xff\xff" + book[end + 6:],
             "crc": book.replace(book[at - 16:at - 12], b"abcd"), "header": book[:at - 30] + b"XXXX" + book[at - 26:]}
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as z, zipfile.ZipFile(buf, "w") as stored:
        for i in z.infolist():
            stored.writestr(i.filename, z.read(i))
    cases["stored"] = buf.getvalue()
    cases["missing"] = pkg([("xl/workbook.xml", WB.format(""))])
    got = {k: list(office.package_tokens("b.xlsx", v)) for k, v in cases.items()}
    monkeypatch.setattr(office, "_at_once", office._zipped)
    assert got == {k: list(office.package_tokens("b.xlsx", v)) for k, v in cases.items()}
    assert [k for k, v in got.items() if any(t[3] == "error" for t in v)] == ["name", "packed", "crc", "header", "missing"]
    assert len(got["sound"]) == len(got["stored"]) > 8


def test_whole_words_start_with_their_literal(spark):
    """The literal is looked at before the word's edges; the lines found are those of Python's own search."""
    import re

    from linesift.operators.grep import compile_search

    lines = ["the", "The end", "other", "the_", "_the", "the-x", "x.the", "éthe", "thé", "bathe the", "thethe", "a+b", "xa+b", "a+bc", "1 a+b 2", "İthe", "", "st theſ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    for needle in ("the", "a+b", "+b", "e", " ", "é"):
        for ignore_case in (False, True):
            s = compile_search(needle, whole_word=True, ignore_case=ignore_case)
            found = re.compile(r"\b" + re.escape(needle) + r"\b", re.I if ignore_case else 0)
            assert sorted(r.i for r in df.where(s.predicate("raw")).collect()) == [i for i, x in enumerate(lines) if found.search(x)], (needle, ignore_case)
            assert "(?=" in s.regex.split(re.escape(needle))[0]
