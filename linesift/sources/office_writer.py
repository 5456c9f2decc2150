"""Office package writer: text rows -> .docx / .xlsx / .pptx bytes (a ``mapInArrow`` step).

Used to turn table rows into real Office packages so the extractors can be
checked against SQL over the same rows (round trips).  One input row gives
one package; nothing is grouped.

Layouts (line = a line of ``text`` without its terminator):
- docx: ``word/document.xml`` one ``w:p`` per line, split in two runs;
  ``word/header1.xml`` = source, ``word/footer1.xml`` = lang;
  ``word/styles.xml`` holds a paragraph that must be ignored.
- xlsx: sheet ``Lines``: ``A{i}`` shared string (two rich-text runs), ``B{i}`` = i;
  sheet ``Meta`` (absolute relationship target): ``A1`` inline string
  ``source/lang``, ``B1`` formula string n_chars, ``C1`` shared index out of
  range, ``D1`` non-numeric shared index, ``E1`` empty.
- pptx: 4 lines per slide, one ``a:p`` per line in two runs; notes per slide
  ``"{lang} {n}"``; one notes part for a slide that does not exist.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A_NS = "http://schemas.openxmlformats.org/drawingml/2006/main"
P_NS = "http://schemas.openxmlformats.org/presentationml/2006/main"
R_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"

LINES_PER_SLIDE = 4
PACKAGE_SCHEMA = "path string, content binary"
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_DECL = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def text_lines(text: str) -> list[str]:
    """Lines as the line scan sees them (universal newlines), without terminators."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    return [piece[:-1] if piece.endswith("\n") else piece for piece in _LINE.findall(t)]


def _halves(line: str) -> tuple[str, str]:
    k = len(line) // 2
    return line[:k], line[k:]


def _t(tag: str, s: str) -> str:
    return f'<{tag} xml:space="preserve">{escape(s)}</{tag}>' if s else f"<{tag}/>"


# The ZIP records of a deflated member (local, and in the directory) and of the directory's end; 1980-01-01, mode 0600.
_LOCAL, _ENTRY, _END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
_DAY, _MODE = 0x21, 0o600 << 16


def _zip(parts: list[tuple[str, str]]) -> bytes:
    """A package of deflated members; many or long ones, whose places need more than 32 bits, are left to the ZIP library."""
    if len(parts) >= 0xFFFF or sum(len(body) for _name, body in parts) >= 1 << 28:
        return _zip_long(parts)
    out, directory, at = [], [], 0
    for name, body in parts:
        label, data = name.encode("ascii"), body.encode("utf-8")
        packer = zlib.compressobj(1, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        known = (8, 0, _DAY, zlib.crc32(data), len(packed), len(data), len(label), 0)
        out += (struct.pack(_LOCAL, b"PK\x03\x04", 20, 0, *known), label, packed)
        directory += (struct.pack(_ENTRY, b"PK\x01\x02", 20 | 3 << 8, 20, 0, *known, 0, 0, 0, _MODE, at), label)
        at += struct.calcsize(_LOCAL) + len(label) + len(packed)
    size = sum(map(len, directory))
    return b"".join((*out, *directory, struct.pack(_END, b"PK\x05\x06", 0, 0, len(parts), len(parts), size, at, 0)))


def _zip_long(parts: list[tuple[str, str]]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, body in parts:
            z.writestr(name, body.encode("utf-8"))
    return buf.getvalue()


def _content_types(kind: str) -> str:
    return f'{_DECL}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><!-- {kind} --></Types>'


def docx_bytes(text: str, source: str, lang: str) -> bytes:
    paras = "".join(
        "<w:p>" + "".join(f"<w:r>{_t('w:t', h)}</w:r>" for h in _halves(line)) + "</w:p>" for line in text_lines(text)
    )
    one = lambda root, s: f'{_DECL}<w:{root} xmlns:w="{W_NS}"><w:p><w:r>{_t("w:t", s)}</w:r></w:p></w:{root}>'
    return _zip(
        [
            ("[Content_Types].xml", _content_types("docx")),
            ("word/document.xml", f'{_DECL}<w:document xmlns:w="{W_NS}"><w:body>{paras}</w:body></w:document>'),
            ("word/header1.xml", one("hdr", source)),
            ("word/footer1.xml", one("ftr", lang)),
            ("word/styles.xml", one("styles", "STYLE")),
        ]
    )


def xlsx_bytes(text: str, source: str, lang: str, n_chars: int) -> bytes:
    lines = text_lines(text)
    sst = "".join("<si>" + "".join(f"<r>{_t('t', h)}</r>" for h in _halves(line)) + "</si>" for line in lines)
    rows = "".join(
        f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="B{i}"><v>{i}</v></c></row>'
        for i in range(1, len(lines) + 1)
    )
    meta = (
        '<row r="1">'
        f'<c r="A1" t="inlineStr"><is><t>{escape(source)}</t><r><t>/</t></r><t>{escape(lang)}</t></is></c>'
        f'<c r="B1" t="str"><f>LEN(Lines!A1)</f><v>{n_chars}</v></c>'
        '<c r="C1" t="s"><v>999999</v></c><c r="D1" t="s"><v>x</v></c><c r="E1"/></row>'
    )
    sheet = lambda body: f'{_DECL}<worksheet xmlns="{S_NS}"><sheetData>{body}</sheetData></worksheet>'
    return _zip(
        [
            ("[Content_Types].xml", _content_types("xlsx")),
            (
                "xl/workbook.xml",
                f'{_DECL}<workbook xmlns="{S_NS}" xmlns:r="{R_NS}"><sheets>'
                '<sheet name="Lines" sheetId="1" r:id="rId1"/><sheet name="Meta" sheetId="2" r:id="rId2"/>'
                "</sheets></workbook>",
            ),
            (
                "xl/_rels/workbook.xml.rels",
                f'{_DECL}<Relationships xmlns="{REL_NS}">'
                '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/>'
                '<Relationship Id="rId3" Target="sharedStrings.xml"/></Relationships>',
            ),
            ("xl/sharedStrings.xml", f'{_DECL}<sst xmlns="{S_NS}">{sst}</sst>'),
            ("xl/worksheets/sheet1.xml", sheet(rows)),
            ("xl/worksheets/sheet2.xml", sheet(meta)),
        ]
    )


def pptx_bytes(text: str, lang: str) -> bytes:
    lines = text_lines(text)
    n_slides = (len(lines) + LINES_PER_SLIDE - 1) // LINES_PER_SLIDE
    parts = [("[Content_Types].xml", _content_types("pptx"))]
    wrap = lambda body: (
        f'{_DECL}<p:sld xmlns:a="{A_NS}" xmlns:p="{P_NS}"><p:cSld><p:spTree><p:sp><p:txBody>'
        f"{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    )
    for n in range(1, n_slides + 1):
        chunk = lines[(n - 1) * LINES_PER_SLIDE : n * LINES_PER_SLIDE]
        body = "".join("<a:p>" + "".join(f"<a:r>{_t('a:t', h)}</a:r>" for h in _halves(line)) + "</a:p>" for line in chunk)
        parts.append((f"ppt/slides/slide{n}.xml", wrap(body)))
    for n in range(1, n_slides + 2):  # the last notes part has no slide
        parts.append((f"ppt/notesSlides/notesSlide{n}.xml", wrap(f"<a:p><a:r>{_t('a:t', f'{lang} {n}')}</a:r></a:p>")))
    return _zip(parts)


def _pack_one(kind: str, row) -> bytes:
    if kind == "docx":
        return docx_bytes(row.text, row.source, row.lang)
    if kind == "xlsx":
        return xlsx_bytes(row.text, row.source, row.lang, int(row.n_chars))
    if kind == "pptx":
        return pptx_bytes(row.text, row.lang)
    return row.text.encode("utf-8")  # "text", or "broken": the text itself under an Office name


PACK_ROWS = 64  # rows taken out of a batch together
PACK_BYTES = 4 << 20  # bytes of packages that go to Spark together


def _pack_batches(kind: str | None, batches: Iterator) -> Iterator:
    """Packages in batches bounded by their bytes; of an input batch only a few rows at a time are Python objects."""
    import pyarrow as pa

    def emit(paths, out):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, type=pa.binary())], names=["path", "content"])

    for batch in batches:
        paths, out, size = [], [], 0
        for i in range(0, batch.num_rows, PACK_ROWS):
            for r in batch.slice(i, PACK_ROWS).to_pylist():
                paths.append(r["path"])
                out.append(_pack_one(kind or r["kind"], _Row(r)))
                size += len(out[-1])
                if size >= PACK_BYTES:
                    yield emit(paths, out)
                    paths, out, size = [], [], 0
        if out:
            yield emit(paths, out)


class _Row:
    """Attribute access over one row dict (``row.text``)."""

    def __init__(self, d: dict):
        self.__dict__.update(d)


def pack(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """``path, text, source, lang, n_chars`` rows -> ``path, content`` packages.

    ``kind`` is ``docx``, ``xlsx``, ``pptx``, ``text`` or ``broken`` (text bytes under an
    Office name); with ``kind=None`` each row names its own in a ``kind`` column.
    """
    cols = ["path", "text", "source", "lang", "n_chars"] + (["kind"] if kind is None else [])
    return rows.select(*cols).mapInArrow(lambda it: _pack_batches(kind, it), PACKAGE_SCHEMA)
