"""Column expressions for lines, paths and display strings.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen.  The character classes are written with ``\\x{..}`` escapes, which
Java regex and RE2 (the DuckDB oracle) read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (the set that
# str.strip/rstrip remove), as one regex character class.
PY_SPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# One line with its terminator, or a last line without one.  Applied after
# \r\n and lone \r were turned into \n (Python's universal-newline reading).
LINE_PIECE = r"[^\n]*\n|[^\n]+"

DISPLAY_WIDTH = 120  # fixed value: CLI view cuts content after 120 characters


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def universal_newlines(text: Column | str) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``; the regex runs only where a ``\\r`` exists."""
    t = _col(text)
    return F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)


def line_pieces(text: Column | str) -> Column:
    """``array<string>`` of lines, each with its ``\\n`` terminator; none for the empty string."""
    return F.regexp_extract_all(universal_newlines(text), F.lit(LINE_PIECE), 0)


def rstrip_py(c: Column | str) -> Column:
    """``str.rstrip()``: remove trailing Unicode whitespace incl. U+001C..U+001F."""
    return F.regexp_replace(_col(c), PY_SPACE_CLASS + r"+\z", "")


def strip_py(c: Column | str) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(_col(c), r"\A" + PY_SPACE_CLASS + "+|" + PY_SPACE_CLASS + r"+\z", "")


def basename(path: Column | str) -> Column:
    """``os.path.basename`` for ``/``-separated paths."""
    return F.substring_index(_col(path), "/", -1)


def extension(base: Column | str) -> Column:
    """``os.path.splitext(base)[1].lower()``: last dot only; leading dots are not an extension."""
    return F.lower(F.regexp_extract(_col(base), r"^\.*[^.].*(\.[^.]*)$", 1))


def parent_dirs(rel_path: Column | str) -> Column:
    """Directory names between the root and the file (``a/b/c.txt`` -> ``[a, b]``)."""
    parts = F.split(_col(rel_path), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def display_location(location: Column | str, line_number: Column | str) -> Column:
    """Location label if present, else the line number as text."""
    return F.coalesce(F.nullif(_col(location), F.lit("")), _col(line_number).cast("string"))


def truncate_display(content: Column | str, width: int = DISPLAY_WIDTH) -> Column:
    """``strip()``, then cut to ``width`` characters plus ``...`` when longer."""
    s = strip_py(content)
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)


def count_matching_chars(text: Column | str, char_class: str) -> Column:
    """Number of characters of ``text`` inside the regex class ``char_class`` (e.g. ``[a-z]``).

    Removes only the (usually rare) matching characters and compares lengths.
    """
    t = _col(text)
    return F.length(t) - F.length(F.regexp_replace(t, char_class, ""))
