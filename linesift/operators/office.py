"""Office extractors (Word, Excel, PowerPoint) as Spark jobs over package tokens.

Python does only what needs a ZIP and an XML parser: narrow ``mapInArrow``
steps turn packages into flat token rows
``path, part, part_ord, kind, ord, parent_ord, ref, type, text, flag, error``.
Everything else -- paragraph ends, run concatenation, paragraph numbering, part
labels, the sheet -> relationship -> part joins, shared strings, slide/notes
pairing, cell counts -- is DataFrame operators over those rows.

A package of up to ``PACKAGE_BYTES`` is read by one task.  Of a longer one a task
reads the directory; its members become rows (place, size), dealt to all tasks,
which read only their bytes.  Parts are streamed.  The tokens are hash-partitioned by
``path`` once, so every later join, aggregate and window on ``(path, ...)``
reuses that partitioning without another shuffle.  A group is at most one
package (bounded by the binary row of the file).

What is staged and shuffled for that is several times the packages.  A package that is
alone with its path needs neither: all its tokens come from one task, in their order.
:func:`split_by_path` tells such packages from the others, :func:`tokenize_split` numbers
their paragraphs and finds their sheets and strings where they are read; the extractors
take it from there.
"""

from __future__ import annotations

import io
import os
import re
import struct
import tempfile
import zipfile
import zlib
import xml.etree.ElementTree as ET
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesift.functions.text import basename, extension, strip_py
from linesift.session import stage

# The OOXML namespaces the extractors read.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
WORD_EXTS = (".docx", ".docm")
EXCEL_EXTS = (".xlsx", ".xlsm")
POWERPOINT_EXTS = (".pptx", ".pptm")
OFFICE_EXTS = WORD_EXTS + EXCEL_EXTS + POWERPOINT_EXTS
KIND_NAME = {**{e: "DOCX" for e in WORD_EXTS}, **{e: "XLSX" for e in EXCEL_EXTS}, **{e: "PPTX" for e in POWERPOINT_EXTS}}

# Part labels, part-name patterns and location formats of the segments.
WORD_HEADER, WORD_FOOTER, WORD_BODY = "Header", "Footer", "Body"
WORD_PART = r"word/(?:document|.*(?:header|footer).*)\.xml"
SLIDE_PART = r"ppt/slides/slide(\d+)\.xml$"
NOTES_PART = r"ppt/notesSlides/notesSlide(\d+)\.xml$"
SLIDE_LABEL = "スライド"
NOTES_LABEL = "(ノート)"
# locations: "{label} P.{i}" (Word), "{sheet}!{cell}" (Excel),
# "スライド {n} P.{i}" and "スライド {n} (ノート) P.{i}" (PowerPoint)

TOKEN_SCHEMA = (
    "path string, part string, part_ord int, kind string, ord long, parent_ord long, "
    "ref string, type string, text string, flag boolean, error string, content binary, texts array<string>"
)
#: Packages up to this length are read by one task, longer ones member by member.
PACKAGE_BYTES = 32 << 20
CHUNK = 1 << 16  # bytes of a part given to the parser at once
SHORT_PART = 1 << 20  # bytes of a part up to which its elements are built at once
#: A part's bytes in chunks; each call starts over.
Chunks = Callable[[], Iterator[bytes]]


def _q(ns: str, tag: str) -> str:
    return "{" + NS[ns] + "}" + tag


def _tok(path, part, part_ord, kind, ord_=0, parent=None, ref=None, type_=None, text=None, flag=None, error=None,
         content=None, texts=None):
    return (path, part, part_ord, kind, ord_, parent, ref, type_, text, flag, error, content, texts)


def _ends(chunks: Chunks) -> Iterator[ET.Element]:
    """The elements of a part at their end tags, while it is read."""
    parser = ET.XMLPullParser(("end",))
    for chunk in chunks():
        parser.feed(chunk)
        yield from (elem for _event, elem in parser.read_events())
    parser.close()
    yield from (elem for _event, elem in parser.read_events())


def _tree(chunks: Chunks) -> ET.Element:
    parser = ET.XMLParser()
    for chunk in chunks():
        parser.feed(chunk)
    return parser.close()


class _Ignored:
    """A parser target that builds nothing."""

    def close(self) -> None:
        return None


def _checked(chunks: Chunks) -> None:
    """Read a part to its end; an ill-formed one raises."""
    parser = ET.XMLParser(target=_Ignored())
    for chunk in chunks():
        parser.feed(chunk)
    parser.close()


def _short(chunks: Chunks) -> ET.Element | None:
    """The elements of a short, well-formed part; None for any other, which is to be streamed."""
    parser, size = ET.XMLParser(), 0
    try:
        for chunk in chunks():
            size += len(chunk)
            if size > SHORT_PART:
                return None
            parser.feed(chunk)
        return parser.close()
    except Exception:  # noqa: BLE001 - found again, and reported, where the part is streamed
        return None


W_P, W_T, S_SI, S_T, S_C, S_V, S_IS, S_ROW = (_q(*x) for x in (("w", "p"), ("w", "t"), ("s", "si"), ("s", "t"), ("s", "c"), ("s", "v"), ("s", "is"), ("s", "row")))
A_P, A_T = _q("a", "p"), _q("a", "t")


def _texts(elem: ET.Element, tag: str) -> list[str]:
    return [t.text for t in elem.iter(tag) if t.text]


def _flat(root: ET.Element, tag: str) -> list[ET.Element] | None:
    """The elements of a tag in the order in which they end; None if one lies inside another."""
    found = list(root.iter(tag))
    return None if any(len(list(x.iter(tag))) > 1 for x in found) else found


def _paragraphs(chunks: Chunks) -> Iterator[tuple[list[str], bool]]:
    """The texts before each paragraph's end, and those after the last one."""
    root = _short(chunks)
    flat = None if root is None else _flat(root, W_P)
    if flat is not None:
        texts = [_texts(p, W_T) for p in flat]
        if sum(map(len, texts)) == len(_texts(root, W_T)):  # all texts lie in paragraphs
            yield from ((x, True) for x in texts)
            return
    texts = []
    for elem in _ends(chunks):
        if elem.tag == W_T and elem.text:
            texts.append(elem.text)
        elif elem.tag == W_P:
            yield texts, True
            texts = []
            elem.clear()
    yield texts, False


def _word_part(tok: Callable[..., tuple], chunks: Chunks) -> Iterator[tuple]:
    """Paragraphs with the texts before their ends (``flag``: ended), in the order of the part; ``ord`` counts the texts."""
    at = 0
    for i, (texts, ended) in enumerate(_paragraphs(chunks)):
        yield tok("w_p", at, i, flag=ended, texts=texts)
        at += len(texts)


def _strings_part(tok: Callable[..., tuple], chunks: Chunks) -> Iterator[tuple]:
    root = _short(chunks)
    flat = None if root is None else _flat(root, S_SI)
    at = index = 0
    for si in _ends(chunks) if flat is None else flat:
        if si.tag == S_SI:
            texts = _texts(si, S_T)
            yield tok("si", at, index, texts=texts)
            at, index = at + len(texts), index + 1
            if flat is None:
                si.clear()


def _sheet_part(tok: Callable[..., tuple], chunks: Chunks) -> Iterator[tuple]:
    """Cells of a sheet with their inline texts; an ill-formed sheet gives none, so it is read to its end before."""
    root = _short(chunks)
    flat = None if root is None else _flat(root, S_C)
    if flat is None:
        _checked(chunks)
    index = at = 0
    for elem in _ends(chunks) if flat is None else flat:
        if elem.tag != S_C:
            if elem.tag == S_ROW:
                elem.clear()
            continue
        value, inline = elem.find(S_V), elem.find(S_IS)
        filled = value is not None or inline is not None or any(x.tag in (S_V, S_IS) for x in elem.iter())
        kind = elem.get("t", "")
        texts = _texts(inline, S_T) if kind == "inlineStr" and inline is not None else []
        yield tok("c", index, at, ref=elem.get("r", ""), type_=kind, text=None if value is None else value.text, flag=filled, texts=texts)
        at, index = at + len(texts), index + 1
        if flat is None:
            elem.clear()


def _slide_part(tok: Callable[..., tuple], chunks: Chunks) -> Iterator[tuple]:
    """Texts of a slide or its notes by paragraph; an ill-formed part gives none."""
    at = 0
    for i, paragraph in enumerate(_tree(chunks).iter(A_P)):
        texts = _texts(paragraph, A_T)
        if texts:
            yield tok("a_p", at, i, texts=texts)
            at += len(texts)


#: How the members of a role are read.
READERS = {"word": _word_part, "strings": _strings_part, "sheet": _sheet_part, "slide": _slide_part}
#: Roles by member name, for the formats whose names tell them.
NAMED_ROLES = {"DOCX": ((WORD_PART, "word", None),), "PPTX": ((SLIDE_PART, "slide", "slide"), (NOTES_PART, "slide", "notes"))}


def _workbook(path: str, zf: zipfile.ZipFile, target_sheets: frozenset[str] | None) -> Iterator[tuple]:
    """Tokens of a workbook's sheets and relationships, then ``(member, part_ord, role)`` of what is to be read."""
    places, wanted = {}, set()
    for part, order, tag, kind in (("xl/workbook.xml", 0, _q("s", "sheet"), "sheet"), ("xl/_rels/workbook.xml.rels", 1, _q("rel", "Relationship"), "rel")):
        for i, elem in enumerate(_tree(_at_once(zf, part)).iter(tag)):
            if kind == "rel":
                ref, text, type_ = elem.get("Id"), elem.get("Target"), None
                places |= {ref: text.removeprefix("/") if text.startswith("/") else f"xl/{text}"} if ref and text else {}
            else:
                ref, text, type_ = elem.get(_q("r", "id")), elem.get("name"), elem.get("sheetId")
                if ref and text and (target_sheets is None or text in target_sheets):
                    wanted.add(ref)
            yield _tok(path, part, order, kind, i, ref=ref, type_=type_, text=text)
    names = set(zf.namelist())
    if "xl/sharedStrings.xml" in names:
        yield "xl/sharedStrings.xml", 2, "strings"
    # Only the parts of wanted sheets are read.
    sheets = {places[ref] for ref in wanted & places.keys()} & names
    yield from ((part, 3 + i, "sheet") for i, part in enumerate(sorted(sheets)))


def _directory(path: str, zf: zipfile.ZipFile, target_sheets: frozenset[str] | None) -> Iterator[tuple]:
    """Tokens that a package's directory (and a workbook's) gives, and ``(member, part_ord, role)`` of what is to be read."""
    format_ = KIND_NAME[_ext(path)]
    if format_ == "XLSX":
        yield from _workbook(path, zf, target_sheets)
        return
    for order, name in enumerate(zf.namelist()):
        for pattern, role, type_ in NAMED_ROLES[format_]:
            m = (re.fullmatch if role == "word" else re.match)(pattern, name)
            if m:
                if type_:
                    yield _tok(path, name, order, "part", int(m.group(1)), type_=type_)
                yield name, order, role
                break


def _ext(path: str) -> str:
    return os.path.splitext(path.rsplit("/", 1)[-1])[1].lower()


def _zipped(zf: zipfile.ZipFile, name: str) -> Chunks:
    def chunks() -> Iterator[bytes]:
        with zf.open(name) as f:
            yield from iter(partial(f.read, CHUNK), b"")

    return chunks


def _at_once(zf: zipfile.ZipFile, name: str) -> Chunks:
    """A short, sound member in one piece; any other, with its errors, is left to the ZIP library."""
    info = zf.getinfo(name)

    def chunks() -> Iterator[bytes]:
        data = _sound(zf.fp, info)
        yield from _zipped(zf, name)() if data is None else (data,)

    return chunks


def _sound(f, info: zipfile.ZipInfo) -> bytes | None:
    """A deflated member's bytes if they, and all that the ZIP library compares, are as the directory says."""
    if info.compress_type != zipfile.ZIP_DEFLATED or info.flag_bits & ~0x80E or info.compress_size > CHUNK:
        return None
    f.seek(info.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return None
    lengths = struct.unpack("<HH", head[26:30])
    name, raw = f.read(sum(lengths))[: lengths[0]], f.read(info.compress_size)
    end = getattr(info, "_end_offset", None)  # where the next member begins
    if end is not None and info.header_offset + 30 + sum(lengths) + info.compress_size > end:
        return None
    try:
        if name.decode("utf-8" if info.flag_bits & 0x800 else "cp437") != info.orig_filename:
            return None
        unpack = zlib.decompressobj(-15)
        data = unpack.decompress(raw, 4 * CHUNK)
    except (UnicodeDecodeError, zlib.error):
        return None
    return data if unpack.eof and len(data) == info.file_size and zlib.crc32(data) == info.CRC else None


def _ranged(f, offset: int, packed: int, method: int, crc: int) -> Chunks:
    """A stored or deflated member by its place in the package; nothing else of the package is read.

    The last chunk comes after the checksum was found right.
    """

    def chunks() -> Iterator[bytes]:
        f.seek(offset)
        head = f.read(30)  # the local header: its last two numbers are the lengths of name and extra fields
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no member at its place in the directory")
        f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        unpack, left, seen, out = zlib.decompressobj(-15) if method else None, packed, 0, b""
        while left:
            raw = f.read(min(CHUNK, left))
            if not raw:
                raise EOFError("the package ends inside a member")
            left -= len(raw)
            while raw:
                if out:
                    yield out
                out, raw = (unpack.decompress(raw, 4 * CHUNK), unpack.unconsumed_tail) if unpack else (raw, b"")
                seen = zlib.crc32(out, seen)
        rest = unpack.flush() if unpack else b""
        if zlib.crc32(rest, seen) != crc:
            raise zipfile.BadZipFile("bad checksum")
        yield out + rest

    return chunks


def _read_in_place(info: zipfile.ZipInfo) -> bool:
    """Whether :func:`_ranged` reads a member; encrypted ones and other methods are left to the ZIP library."""
    return not info.flag_bits & 1 and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)


def _part_tokens(path: str, part: str, order: int, role: str, chunks: Chunks, in_store: bool) -> Iterator[tuple]:
    """Tokens of one member.  What comes before an error in it stays; the error is a row."""
    try:
        yield from READERS[role](partial(_tok, path, part, order), chunks)
    except Exception as e:  # noqa: BLE001 - one part; the others are read
        if in_store and isinstance(e, OSError):
            raise  # the file can't be read
        yield _tok(path, part, order, "error", error=f"Error parsing {KIND_NAME[_ext(path)]} part {part}: {e}")


def package_tokens(path: str, content, target_sheets: frozenset[str] | None = None, members: Callable | None = None,
                   names: list[str] | None = None) -> Iterator[tuple]:
    """Token rows of one package (bytes, or an open file of which only the parts are read), produced lazily.

    A file that is not a package gives an ``error`` row and a ``raw`` row, which has the content if that was given.
    ``members`` makes a row of each member instead of reading it.  ``names`` gets the names of all members before the first token.
    """
    given = isinstance(content, (bytes, bytearray, memoryview))
    if _ext(path) not in OFFICE_EXTS:
        return  # no parser for this extension
    f = io.BytesIO(content) if given else content
    try:
        zf = zipfile.ZipFile(f)
    except Exception as e:  # noqa: BLE001 - not a ZIP package
        if not given and isinstance(e, OSError):
            raise  # the file can't be read
        # Reported, and its bytes kept for the text fallback.  (A file that opens as a ZIP
        # but gives no segments needs no fallback: every ZIP header holds a NUL byte in
        # its first 1,024 bytes, so the text scan would skip it as binary.)
        yield _tok(path, None, None, "error", error=f"Error parsing {KIND_NAME[_ext(path)]} {path}: {e}")
        yield _tok(path, None, None, "raw", content=content if given else None)
        return
    with zf:
        if names is not None:
            names.extend(zf.namelist())
        try:
            for row in _directory(path, zf, target_sheets):
                if len(row) > 3:
                    yield row
                    continue
                info = zf.getinfo(row[0])
                if members:
                    yield members(info, *row)
                    continue
                place = (info.header_offset, info.compress_size, info.compress_type, info.CRC)
                chunks = _ranged(f, *place) if _read_in_place(info) else _zipped(zf, row[0])
                yield from _part_tokens(path, *row, chunks, not given)
        except Exception as e:  # noqa: BLE001 - tokens read so far stay, the package is reported
            if not given and isinstance(e, OSError):
                raise
            yield _tok(path, None, None, "error", error=f"Error parsing {KIND_NAME[_ext(path)]} {path}: {e}")


#: Rows of a package that is alone with its path: its errors, and its paragraphs and cells (kinds ``own_w``, ``own_c``
#: and ``own_a``) with the texts, numbers and sheets (``name``) that aggregates, windows and joins find for other packages.
OWN_SCHEMA = "path string, part string, part_ord int, kind string, ord long, parent_ord long, ref string, type string, text string, error string, content binary, name string"
_LONG = re.compile(r"[\x00-\x20\x7f]*([+-]?)0*([0-9]+)[\x00-\x20\x7f]*")


def _long(value: str | None) -> int | None:
    """``try_cast(value AS BIGINT)``."""
    if value and len(value) < 19 and value.isascii() and value.isdigit():
        return int(value)
    m = _LONG.fullmatch(value or "")
    n = int(m.group(1) + m.group(2)) if m and len(m.group(2)) < 20 else 1 << 63
    return n if -(1 << 63) <= n < 1 << 63 else None


class _Strings:
    """A workbook's shared strings by index; beyond some they lie in a temporary file, with 8 bytes each in memory."""

    def __init__(self) -> None:
        self.held, self.size, self.file, self.ends = [], 0, None, array("q", [0])

    def add(self, texts: list[str]) -> None:  # all of them before the first is taken
        text = "".join(texts)
        self.size += len(text) + 50  # a short string's object
        if self.size <= CHARS_PER_BATCH:
            self.held.append(text)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        data = text.encode()
        self.file.write(data)
        self.ends.append(self.ends[-1] + len(data))

    def get(self, index: int | None) -> str:
        if index is None or index < 0:
            return ""
        if index < len(self.held):
            return self.held[index]
        i = index - len(self.held)
        if i >= len(self.ends) - 1:
            return ""
        self.file.seek(self.ends[i])
        return self.file.read(self.ends[i + 1] - self.ends[i]).decode()

    def __enter__(self) -> _Strings:
        return self

    def __exit__(self, *_error) -> None:
        if self.file:
            self.file.close()


def _passed(t: tuple) -> tuple:
    """A token (an error, or the bytes of what is no package) as a row of ``OWN_SCHEMA``."""
    return (*t[:9], *t[10:12], None)


def _members(tokens: Iterator[tuple], names: list[str]) -> Iterator[tuple[int, int, Iterator[tuple]]]:
    """Of each member: how many have its name, how many of them came before, its tokens."""
    copies, before = Counter(), Counter()
    for (part, _order), rows in groupby(tokens, key=itemgetter(1, 2)):
        if not copies:
            copies.update(names)  # known with the first token
        yield copies[part], before[part], rows
        before[part] += 1


def _own_word(tokens: Iterator[tuple], names: list[str]) -> Iterator[tuple]:
    for copies, copy, rows in _members(tokens, names):
        number = copy + 1  # members of one name, all with the same bytes, take turns
        for t in rows:
            if t[3] != "w_p":
                yield _passed(t)
            elif t[9] and t[12]:
                yield t[0], t[1], t[2], "own_w", number, None, None, None, "".join(t[12]), None, None, None
                number += copies


def _own_slides(tokens: Iterator[tuple], names: list[str]) -> Iterator[tuple]:
    slides = None
    for copies, copy, rows in _members(tokens, names):
        if slides is None:
            slides = {int(m.group(1)) for name in names if (m := re.match(SLIDE_PART, name))}
        number, n, type_, shown = copy + 1, None, None, 0
        for t in rows:
            if t[3] == "part":
                n, type_ = t[4], t[7]
                shown = copies if type_ == "slide" or n in slides else 0  # each paragraph meets each member of that name
            elif t[3] != "a_p":
                yield _passed(t)
            elif text := "".join(t[12]).strip():
                for _ in range(shown):
                    yield t[0], t[1], t[2], "own_a", number, n, None, type_, text, None, None, None
                number += copies


def _own_cells(tokens: Iterator[tuple], names: list[str]) -> Iterator[tuple]:
    sheets, targets, by_part = [], defaultdict(list), None
    with _Strings() as strings:
        for t in tokens:
            kind, ref, text = t[3], t[6], t[8]
            if kind == "sheet":
                sheets += [(t[4], ref, text)] if ref and text else []
            elif kind == "rel":
                targets[ref] += [text[1:] if text.startswith("/") else f"xl/{text}"] if ref is not None and text else []
            elif kind == "si":
                strings.add(t[12])
            elif kind == "c":
                if by_part is None:  # all sheets and relationships come before the first cell
                    by_part = defaultdict(list)
                    for sheet_ord, r_id, sheet in sheets:
                        for part in targets.get(r_id, ()):
                            by_part[part].append((sheet_ord, sheet))
                if t[7] == "s":
                    text = strings.get(_long(text))
                elif t[7] == "inlineStr":
                    text = "".join(t[12])
                for sheet_ord, sheet in by_part.get(t[1], ()):
                    yield t[0], t[1], t[2], "own_c", t[4], sheet_ord, ref, t[7], text, None, None, sheet
            else:
                yield _passed(t)


#: What a package that is alone with its path gives, by format.
OWN = {"DOCX": _own_word, "XLSX": _own_cells, "PPTX": _own_slides}


def own_rows(path: str, content, target_sheets: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows (``OWN_SCHEMA``) of one package that is alone with its path, produced lazily."""
    if _ext(path) in OFFICE_EXTS:
        names: list[str] = []
        yield from OWN[KIND_NAME[_ext(path)]](package_tokens(path, content, target_sheets, names=names), names)


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([
        ("path", pa.string()), ("part", pa.string()), ("part_ord", pa.int32()), ("kind", pa.string()),
        ("ord", pa.int64()), ("parent_ord", pa.int64()), ("ref", pa.string()), ("type", pa.string()),
        ("text", pa.string()), ("flag", pa.bool_()), ("error", pa.string()), ("content", pa.binary()), ("texts", pa.list_(pa.string())),
    ])


# Output batch size: Python memory stays bounded whatever the package size, and however many packages come together.
TOKENS_PER_BATCH = 8_000
CHARS_PER_BATCH = 4 << 20
#: A member row: a token row of kind ``member`` (``ref``: the package's URI, ``type``: the role) with the member's place.
MEMBER_SCHEMA = TOKEN_SCHEMA + ", offset long, packed long, size long, method int, crc long"


def _own_schema():
    import pyarrow as pa

    return pa.schema([*(f for f in _arrow_schema() if f.name not in ("flag", "texts")), pa.field("name", pa.string())])


def _member_schema():
    import pyarrow as pa

    return pa.schema([*_arrow_schema(), *(pa.field(n, pa.int64()) for n in ("offset", "packed", "size")), ("method", pa.int32()), ("crc", pa.int64())])


def _weight(t: tuple) -> int:
    return len(t[8] or "") + len(t[11] or "") + (sum(map(len, t[12])) if t[12] else 0)


def _emitted(tokens: Iterator[tuple], schema=None, weight: Callable[[tuple], int] = _weight) -> Iterator:
    import pyarrow as pa

    schema = schema or _arrow_schema()

    def batch(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows, held = [], 0
    for row in tokens:
        rows.append(row)
        held += weight(row)
        if len(rows) >= TOKENS_PER_BATCH or held >= CHARS_PER_BATCH:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def _token_batches(batches: Iterator, target_sheets) -> Iterator:
    """Arrow record batches of packages -> Arrow record batches of tokens (one package at a time is held as Python bytes)."""
    for batch in batches:
        packages = zip(batch.column("path"), batch.column("content"))
        yield from _emitted(t for path, content in packages for t in package_tokens(path.as_py(), content.as_py(), target_sheets))


def _own_batches(batches: Iterator, target_sheets) -> Iterator:
    for batch in batches:
        packages = zip(batch.column("path"), batch.column("content"))
        yield from _emitted((t for path, content in packages for t in own_rows(path.as_py(), content.as_py(), target_sheets)),
                            _own_schema(), lambda row: len(row[8] or "") + len(row[10] or ""))


def _in_store(uri: str, name: str, read: Callable[..., Iterator[tuple]]) -> Iterator[tuple]:
    """``read`` of a package that is opened where it lies: its directory and parts are read in place, it is never held whole."""
    from linesift.sources.files import _open

    try:
        filesystem, place = _open(uri)
        with filesystem.open_input_file(place) as f:
            yield from read(f)
    except Exception as e:  # noqa: BLE001 - a row of the errors; the scan goes on
        yield _tok(name, None, None, "error", type_="read", error=f"Error accessing file {name}: {e}")


def _file_token_batches(batches: Iterator, target_sheets) -> Iterator:
    for batch in batches:
        files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from _emitted(t for uri, name in files for t in _in_store(uri, name, lambda f, name=name: package_tokens(name, f, target_sheets)))


def _directory_batches(batches: Iterator, target_sheets) -> Iterator:
    none = (None,) * 5

    def rows(uri: str, name: str) -> Iterator[tuple]:
        def member(info: zipfile.ZipInfo, part: str, order: int, role: str) -> tuple:
            method = info.compress_type if _read_in_place(info) else None
            place = (info.header_offset, info.compress_size, info.file_size, method, info.CRC)
            return (*_tok(name, part, order, "member", ref=uri, type_=role), *place)

        for row in _in_store(uri, name, lambda f: package_tokens(name, f, target_sheets, member)):
            yield row if row[3] == "member" else (*row, *none)

    for batch in batches:
        files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from _emitted((r for uri, name in files for r in rows(uri, name)), _member_schema())


def _member_batches(batches: Iterator) -> Iterator:
    def tokens(uri, path, part, order, role, offset, packed, method, crc) -> Iterator[tuple]:
        def read(f) -> Iterator[tuple]:
            if method is not None:
                yield from _part_tokens(path, part, order, role, _ranged(f, offset, packed, method, crc), True)
            else:
                with zipfile.ZipFile(f) as zf:
                    yield from _part_tokens(path, part, order, role, _zipped(zf, part), True)

        yield from _in_store(uri, path, read)

    for batch in batches:
        yield from _emitted(t for row in zip(*(c.to_pylist() for c in batch.columns)) for t in tokens(*row))


def _partitions(df: DataFrame) -> int:
    """At least the configured count, and as many partitions as the input has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        return max(n, df.rdd.getNumPartitions())
    except Exception:  # noqa: BLE001 - no local context: the configured count
        return n


def _partitioned(tokens: DataFrame, n: int, staged: bool) -> DataFrame:
    """Tokens hash-partitioned by path, and staged for the assembly branches that read them."""
    # every join over the tokens is keyed by path plus an inner key (r_id, part, cell, index);
    # partitioning by path co-partitions them, so no join re-shuffles the tokens
    tokens.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # An explicit count (AQE keeps it, so the staged rows stay hash-partitioned by path).
    partitioned = tokens.repartition(n, "path")
    # several assembly branches read the tokens: stage them once.  A single branch (staged=False)
    # keeps the repartition in its own plan, where the kind filter runs before the shuffle.
    return stage(partitioned) if staged else partitioned


def tokenize(packages: DataFrame, target_sheets: Iterable[str] | None = None, staged: bool = True) -> DataFrame:
    """``path, content`` -> token rows (``mapInArrow``), hash-partitioned by ``path`` (one shuffle for all assembly steps).

    The rows are staged (see ``linesift.session.stage``): computed once, then read by every branch.
    """
    ts = frozenset(target_sheets) if target_sheets is not None else None
    toks = packages.select("path", "content").mapInArrow(lambda it: _token_batches(it, ts), TOKEN_SCHEMA)
    return _partitioned(toks, _partitions(packages), staged)


#: Up to so many paths of several packages are told apart; with more of them all packages count as such.
MAX_SHARED = 1 << 17


def split_by_path(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows that are alone with their ``path``, and the others; ``None`` for either if there is none.

    One job, run here, reads the paths.  They are compared by a hash: a path that meets another one's is not alone.
    """
    spark, key = rows.sparkSession, F.xxhash64("path")
    hashes = rows.select(key.alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    found = hashes.limit(MAX_SHARED + 1).toArrow()
    if not found.num_rows:
        return rows, None
    if found.num_rows > MAX_SHARED:
        return None, rows
    shared = F.broadcast(spark.createDataFrame(found))
    return tuple(rows.join(shared, key == F.col("hash"), how) for how in ("left_anti", "left_semi"))


@dataclass(frozen=True)
class SplitTokens:
    """Rows of packages alone with their path (``OWN_SCHEMA``), and the tokens of the others by path; ``None``: there are none."""

    own: DataFrame | None
    shared: DataFrame | None


def tokenize_split(own: DataFrame | None, shared: DataFrame | None, target_sheets: Iterable[str] | None = None) -> SplitTokens:
    """Packages (``path, content``) as :func:`split_by_path` splits them -> their rows; only those of shared paths are staged and shuffled."""
    ts = frozenset(target_sheets) if target_sheets is not None else None
    rows = None if own is None else own.select("path", "content").mapInArrow(lambda it: _own_batches(it, ts), OWN_SCHEMA)
    return SplitTokens(rows, None if shared is None else tokenize(shared, ts))


def _both(tokens: DataFrame | SplitTokens, own: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``shared`` of tokens by path, with ``own`` of what is split from them."""
    if not isinstance(tokens, SplitTokens):
        return shared(tokens)
    found = [f(rows) for f, rows in ((own, tokens.own), (shared, tokens.shared)) if rows is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def package_members(files: DataFrame, target_sheets: Iterable[str] | None = None) -> DataFrame:
    """``path`` (URI), ``file_path`` -> rows of ``MEMBER_SCHEMA``: the tokens of each directory, and a row for each member to be read."""
    ts = frozenset(target_sheets) if target_sheets is not None else None
    return files.select("path", "file_path").mapInArrow(lambda it: _directory_batches(it, ts), MEMBER_SCHEMA)


def member_tokens(members: DataFrame, n: int) -> DataFrame:
    """The tokens of members (rows of kind ``member``), dealt to ``n`` tasks; each reads its members' bytes only."""
    rows = members.where(F.col("kind") == "member").repartition(n, "path", "part")
    return rows.select("ref", "path", "part", "part_ord", "type", "offset", "packed", "method", "crc").mapInArrow(_member_batches, TOKEN_SCHEMA)


def tokenize_files(files: DataFrame, target_sheets: Iterable[str] | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """``path`` (URI), ``file_path``, ``length`` of a listing -> the token rows of packages of any size, read in place.

    Packages longer than ``package_bytes`` are read member by member; the rows are the same for any value.
    """
    ts = frozenset(target_sheets) if target_sheets is not None else None
    n = _partitions(files)
    whole = files.where(F.col("length") <= package_bytes).select("path", "file_path").mapInArrow(lambda it: _file_token_batches(it, ts), TOKEN_SCHEMA)
    # The directories of long packages are few bytes: read once for their tokens and once for their members.
    long = package_members(files.where(F.col("length") > package_bytes), ts)
    given = long.where(F.col("kind") != "member").select(*whole.columns)
    return _partitioned(whole.unionByName(given).unionByName(member_tokens(long, n)), n, True)


def joined_runs(at: str) -> Column:
    """The text runs of a group joined in their order: column ``at`` numbers a row's first run in its part.

    A group is one row, unless several packages have the same path.
    """
    rows = F.collect_list(F.struct(F.col(at).alias("at"), F.col("texts")))
    runs = F.flatten(F.transform(rows, lambda r: F.transform(r["texts"], lambda x, i: F.struct((r["at"] + i).alias("at"), x.alias("text")))))
    several = F.array_join(F.transform(F.array_sort(runs), lambda x: x["text"]), "")
    return F.when(F.size(rows) == 1, F.array_join(F.get(rows, F.lit(0))["texts"], "")).otherwise(several)


def _segments(df: DataFrame, raw: Column, location: Column, meta: Column, seq: Column) -> DataFrame:
    return df.select(
        F.col("path").alias("file_path"),
        extension(basename(F.col("path"))).alias("ext"),
        seq.cast("long").alias("seq"),
        raw.alias("raw"),
        F.lit(0).alias("line_number"),
        location.alias("location_display"),
        meta.alias("metadata"),
    )


def unreadable_packages(tokens: DataFrame | SplitTokens) -> DataFrame:
    """``file_path, content`` of files with an Office name that are not packages (for the text fallback)."""
    raw = lambda t: t.where(F.col("kind") == "raw").select(F.col("path").alias("file_path"), "content")
    return _both(tokens, raw, raw)


def errors(tokens: DataFrame | SplitTokens) -> DataFrame:
    """Side output: ``file_path, stage, message``."""
    failed = lambda t: t.where(F.col("kind") == "error").select(
        F.col("path").alias("file_path"), F.coalesce("type", F.lit("extract")).alias("stage"), F.col("error").alias("message")
    )
    return _both(tokens, failed, failed)


def _numbered_paragraphs(tokens: DataFrame) -> DataFrame:
    found = tokens.where(F.col("kind") == "w_p")
    # A paragraph's end closes the texts since the end before it; texts after the last end belong to none.
    # Grouped in the window's order, so the rows are sorted once.
    paras = found.groupBy("path", "part", "parent_ord", "part_ord").agg(
        joined_runs("ord").alias("text"), F.sum(F.size("texts")).alias("texts"), F.bool_or("flag").alias("ended"))
    w = Window.partitionBy("path", "part").orderBy("parent_ord")
    return paras.where("ended AND texts > 0").select("path", "part", "part_ord", "text", F.row_number().over(w).alias("i"))


def word_paragraphs(tokens: DataFrame | SplitTokens) -> DataFrame:
    """Word segments: non-empty paragraphs numbered per part, ``"{Body|Header|Footer} P.{i}"``."""
    own = lambda rows: rows.where(F.col("kind") == "own_w").select("path", "part", "part_ord", "text", F.col("ord").alias("i"))
    numbered = _both(tokens, own, _numbered_paragraphs)
    label = F.when(F.contains("part", F.lit("header")), F.lit(WORD_HEADER)).when(F.contains("part", F.lit("footer")), F.lit(WORD_FOOTER))
    return _segments(
        numbered.withColumn("type", label.otherwise(F.lit(WORD_BODY))),
        F.col("text"),
        F.concat(F.col("type"), F.lit(" P."), F.col("i").cast("string")),
        F.create_map(F.lit("xml"), F.col("part"), F.lit("type"), F.col("type")),
        F.col("part_ord") * F.lit(1 << 32) + F.col("i"),
    )


def _sheet_parts(tokens: DataFrame, target_sheets: Iterable[str] | None = None) -> DataFrame:
    sheets = tokens.where((F.col("kind") == "sheet") & F.col("ref").isNotNull() & (F.col("ref") != "")
                          & F.col("text").isNotNull() & (F.col("text") != ""))
    sheets = sheets.select("path", F.col("ord").alias("sheet_ord"), F.col("ref").alias("r_id"), F.col("text").alias("sheet"))
    if target_sheets is not None:
        sheets = sheets.where(F.col("sheet").isin(list(target_sheets)))
    rels = tokens.where((F.col("kind") == "rel") & F.col("ref").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    target = F.col("text")
    part = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.lit("xl/"), target))
    rels = rels.select("path", F.col("ref").alias("r_id"), part.alias("part"))
    return sheets.join(rels, ["path", "r_id"])


def shared_strings(tokens: DataFrame) -> DataFrame:
    """``path, idx, text``: every ``si`` (also empty ones, they hold an index) with its runs joined.

    One aggregate over the ``si`` rows (no join): a string without runs comes out empty.
    """
    parts = tokens.where(F.col("kind") == "si").select("path", F.col("parent_ord").alias("idx"), "ord", "texts")
    return parts.groupBy("path", "idx").agg(joined_runs("ord").alias("text"))


def excel_cells_raw(tokens: DataFrame, target_sheets: Iterable[str] | None = None) -> DataFrame:
    """Every cell of every wanted sheet with its display text (empty text kept)."""
    parts = _sheet_parts(tokens, target_sheets)
    cells = tokens.where(F.col("kind") == "c").select(
        "path", "part", "part_ord", F.col("ord").alias("cell_ord"), F.col("ref").alias("cell"),
        F.col("type").alias("ctype"), F.col("text").alias("v"),
    )
    inline = tokens.where((F.col("kind") == "c") & (F.size("texts") > 0)).groupBy("path", "part", F.col("ord").alias("cell_ord")).agg(
        joined_runs("parent_ord").alias("inline_text")
    )
    sst = shared_strings(tokens).withColumnRenamed("text", "shared_text")
    joined = (
        cells.join(inline, ["path", "part", "cell_ord"], "left")  # leaves the cells in the next join's order
        .join(parts, ["path", "part"])
        .withColumn("idx", F.when(F.col("ctype") == "s", F.expr("try_cast(v AS BIGINT)")))
        .join(sst, ["path", "idx"], "left")
    )
    display = (
        F.when(F.col("ctype") == "inlineStr", F.coalesce("inline_text", F.lit("")))
        .when(F.col("ctype") == "s", F.coalesce("shared_text", F.lit("")))
        .otherwise(F.coalesce("v", F.lit("")))
    )
    return joined.withColumn("display", display)


def _own_cells_raw(rows: DataFrame, target_sheets: Iterable[str] | None = None) -> DataFrame:
    cells = rows.where(F.col("kind") == "own_c")
    if target_sheets is not None:
        cells = cells.where(F.col("name").isin(list(target_sheets)))
    return cells.select("path", F.col("name").alias("sheet"), F.col("parent_ord").alias("sheet_ord"), F.col("ref").alias("cell"),
                        F.col("ord").alias("cell_ord"), F.col("text").alias("display"))


def excel_cells(tokens: DataFrame | SplitTokens, target_sheets: Iterable[str] | None = None) -> DataFrame:
    """Excel segments: non-empty cells, location ``"{sheet}!{cell}"``."""
    columns = ("path", "sheet", "sheet_ord", "cell", "cell_ord", "display")
    cells = _both(tokens, lambda rows: _own_cells_raw(rows, target_sheets).select(*columns), lambda t: excel_cells_raw(t, target_sheets).select(*columns))
    cells = cells.where(F.col("display") != "")
    return _segments(
        cells,
        F.col("display"),
        F.concat(F.col("sheet"), F.lit("!"), F.col("cell")),
        F.create_map(F.lit("sheet"), F.col("sheet"), F.lit("cell"), F.col("cell")),
        F.col("sheet_ord") * F.lit(1 << 32) + F.col("cell_ord"),
    )


def excel_shared_join(tokens: DataFrame) -> DataFrame:
    """The cell -> shared string join: ``file_path, sheet, cell, idx, text`` for cells of type ``s``."""
    cells = excel_cells_raw(tokens).where(F.col("ctype") == "s")
    return cells.select(F.col("path").alias("file_path"), "sheet", "cell", "idx", F.col("display").alias("text"))


def excel_sheet_summary(tokens: DataFrame) -> DataFrame:
    """Per sheet: ``file_path, sheet, sheet_id, cell_count`` (cells holding a ``v`` or ``is``; 0 if the part is missing).

    Needs tokens from ``tokenize`` without a sheet filter (a filter skips the other sheets' parts).
    """
    sheets = tokens.where((F.col("kind") == "sheet") & (F.coalesce("ref", F.lit("")) != "")
                          & (F.coalesce("text", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != ""))
    sheets = sheets.select("path", F.col("ref").alias("r_id"), F.col("text").alias("sheet"),
                           F.expr("try_cast(type AS INT)").alias("sheet_id"))
    rels = _sheet_parts(tokens).select("path", "r_id", "part")
    counts = tokens.where(F.col("kind") == "c").groupBy("path", "part").agg(F.count_if(F.col("flag")).alias("cell_count"))
    return (
        sheets.join(rels, ["path", "r_id"], "left")
        .join(counts, ["path", "part"], "left")
        .select(F.col("path").alias("file_path"), "sheet", "sheet_id",
                F.coalesce("cell_count", F.lit(0)).cast("long").alias("cell_count"))
    )


def excel_workbook_totals(summary: DataFrame) -> DataFrame:
    """Per workbook: ``sheet_count, total_cells``."""
    return summary.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("sheet_count"), F.sum("cell_count").cast("long").alias("total_cells")
    )


def _numbered_slides(tokens: DataFrame) -> DataFrame:
    parts = tokens.where(F.col("kind") == "part").select("path", "part", F.col("ord").alias("n"), F.col("type").alias("ptype"))
    slides = parts.where(F.col("ptype") == "slide").select("path", "n")
    notes_ok = parts.where(F.col("ptype") == "notes").join(slides, ["path", "n"], "left_semi")
    parts_ok = parts.where(F.col("ptype") == "slide").unionByName(notes_ok)
    runs = tokens.where(F.col("kind") == "a_p")
    paras = runs.groupBy("path", "part", "parent_ord", "part_ord").agg(joined_runs("ord").alias("text"))
    paras = paras.withColumn("text", strip_py(F.col("text"))).where(F.col("text") != "")
    w = Window.partitionBy("path", "part").orderBy("parent_ord")
    return paras.withColumn("i", F.row_number().over(w)).join(parts_ok, ["path", "part"]).select("path", "n", "ptype", "i", "text")


def powerpoint_paragraphs(tokens: DataFrame | SplitTokens) -> DataFrame:
    """PowerPoint segments: stripped non-empty paragraphs per slide, notes right after their slide."""
    own = lambda rows: rows.where(F.col("kind") == "own_a").select(
        "path", F.col("parent_ord").alias("n"), F.col("type").alias("ptype"), F.col("ord").alias("i"), "text")
    numbered = _both(tokens, own, _numbered_slides)
    label = F.concat(
        F.lit(SLIDE_LABEL + " "), F.col("n").cast("string"),
        F.when(F.col("ptype") == "notes", F.lit(" " + NOTES_LABEL)).otherwise(F.lit("")),
        F.lit(" P."), F.col("i").cast("string"),
    )
    return _segments(
        numbered,
        F.col("text"),
        label,
        F.create_map(F.lit("slide"), F.col("n").cast("string"), F.lit("type"), F.col("ptype")),
        F.col("n") * F.lit(1 << 33) + F.when(F.col("ptype") == "notes", F.lit(1 << 32)).otherwise(F.lit(0)) + F.col("i"),
    )


def office_segments(tokens: DataFrame | SplitTokens, target_sheets: Iterable[str] | None = None) -> DataFrame:
    """Segments of all packages (the parser dispatch by extension happens in the tokenizer)."""
    return word_paragraphs(tokens).unionByName(excel_cells(tokens, target_sheets)).unionByName(powerpoint_paragraphs(tokens))
