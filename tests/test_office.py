"""Office extractors on hand-built packages (the reference's fixtures) and edge cases."""

import io
import zipfile

from pyspark.sql import functions as F

from linesift.operators import office
from linesift.sources.office_writer import A_NS, P_NS, R_NS, REL_NS, S_NS, W_NS


def pkg(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in parts:
            z.writestr(name, body)
    return buf.getvalue()


def toks(spark, *files):
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    return office.tokenize(df)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


WB = (f'<workbook xmlns="{S_NS}" xmlns:r="{R_NS}"><sheets>{{}}</sheets></workbook>')
RELS = f'<Relationships xmlns="{REL_NS}">{{}}</Relationships>'


def sheet(body):
    return f'<worksheet xmlns="{S_NS}"><sheetData>{body}</sheetData></worksheet>'


def xlsx_fixture():
    return pkg([
        ("xl/workbook.xml", WB.format('<sheet name="Sheet1" sheetId="1" r:id="rId1"/>')),
        ("xl/_rels/workbook.xml.rels", RELS.format('<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>')),
        ("xl/sharedStrings.xml", f'<sst xmlns="{S_NS}"><si><t>Hello</t></si><si><r><t>Wor</t></r><r><t>ld</t></r></si></sst>'),
        ("xl/worksheets/sheet1.xml", sheet(
            '<row r="1"><c r="A1" t="inlineStr"><is><t>Inline</t></is></c><c r="B1" t="s"><v>1</v></c></row>'
            '<row r="2"><c r="C2"><v>999</v></c><c r="D2" t="s"><v>7</v></c><c r="E2"/></row>')),
    ])


def test_xlsx_cells(spark):
    segs = office.excel_cells(toks(spark, ("w.xlsx", xlsx_fixture())))
    assert rows(segs, "location_display", "raw") == [("Sheet1!A1", "Inline"), ("Sheet1!B1", "World"), ("Sheet1!C2", "999")]


def test_xlsx_two_sheets_filter_and_summary(spark):
    data = pkg([
        ("xl/workbook.xml", WB.format('<sheet name="SheetA" sheetId="1" r:id="rId1"/><sheet name="SheetB" sheetId="2" r:id="rId2"/>')),
        ("xl/_rels/workbook.xml.rels", RELS.format(
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/>')),
        ("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="str"><v>a</v></c></row>')),
        ("xl/worksheets/sheet2.xml", sheet('<row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c><c r="C1"/></row>')),
    ])
    t = office.tokenize(spark.createDataFrame([("s.xlsx", bytearray(data))], "path string, content binary"), ["SheetA"])
    assert rows(office.excel_cells(t, ["SheetA"]), "location_display") == [("SheetA!A1",)]
    summary = office.excel_sheet_summary(toks(spark, ("s.xlsx", data)))
    assert rows(summary, "sheet", "sheet_id", "cell_count") == [("SheetA", 1, 1), ("SheetB", 2, 2)]
    totals = office.excel_workbook_totals(summary).collect()[0]
    assert (totals.sheet_count, totals.total_cells) == (2, 3)


def wdoc(root, *paras):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" if p else "<w:p/>" for p in paras)
    return f'<w:{root} xmlns:w="{W_NS}"><w:body>{body}</w:body></w:{root}>'


def test_docx_parts_and_numbering(spark):
    data = pkg([
        ("word/document.xml", wdoc("document", "one", "", "two")),
        ("word/header1.xml", wdoc("hdr", "head")),
        ("word/footer2.xml", wdoc("ftr", "foot")),
        ("word/settings.xml", wdoc("settings", "ignored")),
    ])
    segs = office.word_paragraphs(toks(spark, ("d.docx", data)))
    assert rows(segs, "location_display", "raw") == [
        ("Body P.1", "one"), ("Body P.2", "two"), ("Footer P.1", "foot"), ("Header P.1", "head")]
    meta = {r.location_display: dict(r.metadata) for r in segs.collect()}
    assert meta["Header P.1"] == {"xml": "word/header1.xml", "type": "Header"}


def test_docx_nested_paragraph_quirk(spark):
    nested = (f'<w:document xmlns:w="{W_NS}"><w:body><w:p><w:r><w:t>a</w:t></w:r>'
              '<w:p><w:r><w:t>b</w:t></w:r></w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    segs = office.word_paragraphs(toks(spark, ("n.docx", pkg([("word/document.xml", nested)]))))
    assert rows(segs, "location_display", "raw") == [("Body P.1", "ab"), ("Body P.2", "c")]


def slide(*paras):
    body = "".join("<a:p>" + "".join(f"<a:r><a:t>{t}</a:t></a:r>" for t in p) + "</a:p>" for p in paras)
    return f'<p:sld xmlns:a="{A_NS}" xmlns:p="{P_NS}"><p:cSld><p:spTree><p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'


def test_pptx_notes_and_numeric_order(spark):
    data = pkg([
        ("ppt/slides/slide1.xml", slide(["Title ", " text"], ["  "], ["second"])),
        ("ppt/notesSlides/notesSlide1.xml", slide(["note"])),
        ("ppt/slides/slide10.xml", slide(["ten"])),
        ("ppt/slides/slide2.xml", slide(["two"])),
        ("ppt/notesSlides/notesSlide3.xml", slide(["orphan"])),
    ])
    segs = office.powerpoint_paragraphs(toks(spark, ("p.pptx", data)))
    ordered = [r.location_display for r in segs.orderBy("seq").collect()]
    assert ordered == ["スライド 1 P.1", "スライド 1 P.2", "スライド 1 (ノート) P.1", "スライド 2 P.1", "スライド 10 P.1"]
    assert rows(segs.where("location_display = 'スライド 1 P.1'"), "raw") == [("Title  text",)]


def test_broken_packages_report_errors(spark):
    t = toks(spark, ("x.xlsx", b"plain text"), ("y.docx", b"plain text"))
    assert office.office_segments(t).count() == 0
    errs = rows(office.errors(t), "file_path", "message")
    assert [e[0] for e in errs] == ["x.xlsx", "y.docx"]
    assert errs[0][1].startswith("Error parsing XLSX x.xlsx")


def test_phonetic_runs_are_joined(spark):
    """Shared strings join every text run below ``si``, phonetic guides included (kept quirk)."""
    data = pkg([
        ("xl/workbook.xml", WB.format('<sheet name="S" sheetId="1" r:id="rId1"/>')),
        ("xl/_rels/workbook.xml.rels", RELS.format('<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>')),
        ("xl/sharedStrings.xml", f'<sst xmlns="{S_NS}"><si><t>漢字</t><rPh sb="0" eb="2"><t>かんじ</t></rPh></si></sst>'),
        ("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c></row>')),
    ])
    assert rows(office.excel_cells(toks(spark, ("k.xlsx", data))), "raw") == [("漢字かんじ",)]


def test_broken_xml_inside_good_package(spark):
    good_then_bad = f'<w:document xmlns:w="{W_NS}"><w:body><w:p><w:r><w:t>kept</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t>'
    docx = pkg([("word/document.xml", good_then_bad)])
    pptx = pkg([("ppt/slides/slide1.xml", slide(["fine"])), ("ppt/slides/slide2.xml", "<p:sld><broken")])
    t = toks(spark, ("d.docx", docx), ("p.pptx", pptx))
    assert rows(office.word_paragraphs(t), "raw") == [("kept",)]  # paragraphs before the error stay
    assert rows(office.powerpoint_paragraphs(t), "location_display") == [("スライド 1 P.1",)]  # the broken slide gives none
    assert sorted(e[0] for e in rows(office.errors(t), "file_path", "message")) == ["d.docx", "p.pptx"]


def test_file_lists_from_office_hits(spark):
    """-l / -L and per-file counts over hits that come from Office segments (semi/anti joins)."""
    from linesift.operators import output
    from linesift.operators.grep import grep
    from linesift.sources.office_writer import docx_bytes

    t = toks(spark, ("a.docx", docx_bytes("needle\nneedle again\nx", "s", "l")), ("b.docx", docx_bytes("nothing", "s", "l")))
    hits = grep(office.word_paragraphs(t), "needle")
    files = spark.createDataFrame([("a.docx",), ("b.docx",)], "file_path string")
    assert rows(output.files_with_hits(files, hits), "file_path") == [("a.docx",)]
    assert rows(output.files_without_hits(files, hits), "file_path") == [("b.docx",)]
    assert rows(output.hits_per_file(hits), "file_path", "hits") == [("a.docx", 2)]


def test_extension_from_the_base_name(spark):
    from linesift.sources.office_writer import docx_bytes

    t = toks(spark, ("dir.v2/report.docx", docx_bytes("hello", "s", "l")), ("pkg.docx/notes", b"plain"))
    segs = office.word_paragraphs(t).where("location_display = 'Body P.1'")
    assert rows(segs, "file_path", "ext") == [("dir.v2/report.docx", ".docx")]
    assert office.errors(t).count() == 0  # "pkg.docx/notes" has no Office extension: not tokenised


def test_round_trip_with_markup_characters(spark):
    """Packed and extracted again: XML-special characters, whitespace-only lines and non-Latin text survive."""
    from linesift.sources.office_writer import docx_bytes, pptx_bytes, text_lines

    texts = ["a < b && c > d\n\"quoted\" 'single'\n   \nlast", "日本語 & <tag>\n\n\tindent\r\nend ", "x"]
    files = [(f"t{i}.docx", docx_bytes(t, "s", "l")) for i, t in enumerate(texts)]
    files += [(f"t{i}.pptx", pptx_bytes(t, "l")) for i, t in enumerate(texts)]
    t = toks(spark, *files)
    word = {}
    for r in office.word_paragraphs(t).where("location_display LIKE 'Body%'").collect():
        word.setdefault(r.file_path, []).append((int(r.location_display.split(".")[-1]), r.raw))
    for i, text in enumerate(texts):
        want = [line for line in text_lines(text) if line]
        assert [raw for _, raw in sorted(word[f"t{i}.docx"])] == want
    slides = {}
    for r in office.powerpoint_paragraphs(t).where("metadata['type'] = 'slide'").collect():
        slides.setdefault(r.file_path, []).append((int(r.metadata["slide"]), int(r.location_display.split(".")[-1]), r.raw))
    for i, text in enumerate(texts):
        lines = text_lines(text)
        want = []
        for n in range(0, len(lines), 4):
            kept = [ln.strip() for ln in lines[n:n + 4] if ln.strip()]
            want += [(n // 4 + 1, j + 1, ln) for j, ln in enumerate(kept)]
        assert sorted(slides.get(f"t{i}.pptx", [])) == want


def _tree_of_packages(tmp_path):
    """Packages of every kind: many sheets, stored and bzip2 members, broken parts, a wrong checksum, a cut file, no package."""
    sheets = [(f"xl/worksheets/sheet{i}.xml", sheet(f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>i{i}</t></is></c></row>')) for i in range(40)]
    sheets[7] = (sheets[7][0], sheets[7][1][:-20])  # ill-formed after its cells
    book = pkg([
        ("xl/workbook.xml", WB.format("".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(40)))),
        ("xl/_rels/workbook.xml.rels", RELS.format("".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(40)))),
        ("xl/sharedStrings.xml", f'<sst xmlns="{S_NS}"><si><t>shared</t></si></sst>'), *sheets])
    docx = [("word/document.xml", wdoc("document", "one", "", "two")), ("word/header1.xml", wdoc("hdr", "head")), ("word/other.xml", "<x/>")]
    slides = [("ppt/slides/slide1.xml", slide(["title"], [" "], ["text"])), ("ppt/notesSlides/notesSlide1.xml", slide(["note"])), ("ppt/slides/slide2.xml", "<p:sld><broken")]
    out = {"many.xlsx": book, "stored.docx": pkg(docx)}
    for name, parts, method in (("packed.docx", docx, zipfile.ZIP_DEFLATED), ("bz.docx", docx, zipfile.ZIP_BZIP2), ("s.pptx", slides, zipfile.ZIP_DEFLATED)):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", method) as z:
            for part, body in parts:
                z.writestr(part, body)
        out[name] = buf.getvalue()
    out["crc.docx"] = out["stored.docx"].replace(b"<w:t>one", b"<w:t>0ne")
    out["plain.xlsx"], out["cut.docx"], out["empty.pptx"] = b"plain text", out["packed.docx"][:200], b""
    for name, content in out.items():
        (tmp_path / name).write_bytes(content)
    listed = [(f"file:{tmp_path}/{name}", name, len(content)) for name, content in out.items()]
    return listed, "path string, file_path string, length long"


def test_members_as_rows(spark, tmp_path):
    """Packages read member by member give the tokens, segments and errors of packages read whole."""
    files = spark.createDataFrame(*_tree_of_packages(tmp_path))
    whole, parted = office.tokenize_files(files, package_bytes=1 << 40), office.tokenize_files(files, package_bytes=0)
    seen = lambda t: rows(office.office_segments(t), "file_path", "location_display", "raw", "seq")
    assert seen(whole) == seen(parted)
    got = [r for r in seen(parted) if r[0] == "many.xlsx"]
    assert len(got) == 78 and not [r for r in got if r[1].startswith("S7!")]  # the ill-formed sheet gives no cell
    failed = lambda t: sorted(r.file_path for r in office.errors(t).collect())
    assert failed(whole) == failed(parted) == ["crc.docx", "cut.docx", "empty.pptx", "many.xlsx", "plain.xlsx", "s.pptx"]
    members = office.package_members(files).where("kind = 'member'")
    sizes = {(r.path, r.part): (r.packed, r.size) for r in members.collect()}
    assert len([k for k in sizes if k[0] == "many.xlsx"]) == 41 and sizes["stored.docx", "word/document.xml"][0] == sizes["stored.docx", "word/document.xml"][1]
    # The sheets of one workbook are read by many tasks.
    tasks = office.member_tokens(office.package_members(files.where("file_path = 'many.xlsx'")), 16).withColumn("t", F.spark_partition_id())
    assert tasks.where("kind = 'c'").select("t").distinct().count() > 8
    few = office.tokenize_files(files, ["S3", "S9"], package_bytes=0)
    assert {r.location_display.split("!")[0] for r in office.excel_cells(few, ["S3", "S9"]).collect()} == {"S3", "S9"}


def test_nothing_runs_before_an_action(spark, tmp_path):
    files = spark.createDataFrame(*_tree_of_packages(tmp_path))
    spark.sparkContext.setJobGroup("lazy-office", "")
    segments = office.office_segments(office.tokenize_files(files))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-office")
    assert segments.count() > 80
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-office")
    spark.sparkContext.setJobGroup("other", "")


def test_batches_are_bounded_by_their_bytes():
    """400 packages that come as one batch go on in small ones, as packages and as tokens."""
    import random

    import pyarrow as pa

    from linesift.sources import office_writer

    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400)) for _ in range(100)) for _ in range(400)]
    for kind in ("docx", "xlsx", "pptx"):
        rows = pa.RecordBatch.from_pydict({"path": [f"{i}.{kind}" for i in range(400)], "text": texts, "source": ["s"] * 400, "lang": ["l"] * 400, "n_chars": [1] * 400})
        packed = list(office_writer._pack_batches(kind, iter([rows])))
        assert sum(b.num_rows for b in packed) == 400 and max(b.nbytes for b in packed) < 6 << 20
        tokens = list(office._token_batches(iter(packed), None))
        assert max(b.nbytes for b in tokens) < 8 << 20 and max(b.num_rows for b in tokens) <= 8_000
        assert len({p for b in tokens for p in b.column("path").to_pylist()}) == 400
