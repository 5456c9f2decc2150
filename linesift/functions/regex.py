"""Regex dialect: Python ``re`` patterns run as Java regex inside Spark.

Patterns are compiled with ``re`` on the driver first, so an invalid pattern
fails before any task starts, with the same message the reference gives.  The
translated pattern gets the flags ``U`` (Unicode ``\\w \\d \\s \\b`` and case
folding, as Python's ``str`` patterns) and ``d`` (``.``, ``$`` know only ``\\n``).
"""

from __future__ import annotations

import fnmatch
import re
import unicodedata

_QUANT = re.compile(r"\{(\d*)(,?)(\d*)\}")


class RegexDialectError(ValueError):
    """A Python construct that has no Java equivalent."""


def validate(pattern: str, ignore_case: bool = False) -> None:
    """Compile with Python's ``re``; raise ``ValueError`` like the reference does."""
    try:
        re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error as e:
        raise ValueError(f"Invalid regular expression: {e}") from None


#: Python's word characters (letters, all kinds of numbers, underscore); Java's Unicode ``\\w`` has marks and connectors instead.
WORD = r"\p{L}\p{N}_"
#: Python's white space: Java's and U+001C..U+001F.
SPACE = r"\s\x1c-\x1f"
_OUTSIDE = {
    "w": f"[{WORD}]",
    "W": f"[^{WORD}]",
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}])(?!\\A\\z))",
    "Z": r"\z",
    "v": r"\x0b",
}
_INSIDE = {"w": WORD, "W": f"[^{WORD}]", "s": SPACE, "S": f"[^{SPACE}]", "b": r"\x08", "v": r"\x0b"}
_CHARACTER = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|N\{([^}]+)\})")
_OCTAL = re.compile(r"\\(0[0-7]{0,2}|[0-3][0-7]{2})")
_OCTAL_INSIDE = re.compile(r"\\([0-7]{1,3})")


def _escape(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """The escape at ``i`` in Java's syntax, and where it ends."""
    m = _CHARACTER.match(pattern, i)
    if m:
        code = ord(unicodedata.lookup(m[4])) if m[4] else int(m[1] or m[2] or m[3], 16)
        return f"\\x{{{code:x}}}", m.end()
    m = (_OCTAL_INSIDE if in_class else _OCTAL).match(pattern, i)
    if m:
        return f"\\x{{{int(m[1], 8):x}}}", m.end()
    if not in_class and pattern[i + 1].isdigit():  # a group's number has two digits at most
        number = re.compile(r"\d{1,2}").match(pattern, i + 1)[0]
        return f"(?:\\{number})", i + 1 + len(number)
    known = (_INSIDE if in_class else _OUTSIDE).get(pattern[i + 1])
    return known or pattern[i : i + 2], i + 2


def _group_name(name: str) -> str:
    """Java's group names are ASCII letters and digits; others are spelled by their code points."""
    return name if re.fullmatch("[A-Za-z][A-Za-z0-9]*", name) else "u" + "z".join(f"{ord(c):x}" for c in name)


def to_java(pattern: str) -> str:
    """Translate the Python-only syntax of ``pattern`` into Java regex syntax.

    Handles ``\\w \\b \\s`` and their opposites by Python's sets, character escapes
    (``\\0 \\v \\U \\N [\\b]``), named groups, ``\\Z``, ``{,m}`` quantifiers, a literal
    ``{``, and ``[``/``&`` inside classes (Java would read nested classes and
    intersections).  Conditionals and scoped ASCII/locale flags are rejected.
    """
    out: list[str] = []
    i, n = 0, len(pattern)
    in_class = False
    class_start = 0
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            text, i = _escape(pattern, i, in_class)
            out.append(text)
            continue
        if in_class:
            if ch == "]" and i > class_start:
                in_class = False
                out.append(ch)
            elif ch in "[& #":
                out.append("\\" + ch)
            else:
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            class_start = i  # a ']' right here is a literal member
            if i < n and pattern[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        named = re.compile(r"\(\?P(?:<(\w+)>|=(\w+)\))").match(pattern, i)
        if named:
            out.append(f"(?<{_group_name(named[1])}>" if named[1] else f"\\k<{_group_name(named[2])}>")
            i = named.end()
            continue
        if pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
            continue
        if pattern.startswith("(?(", i):
            raise RegexDialectError("conditional groups are not supported by the Java regex engine")
        if re.match(r"\(\?[aL]", pattern[i:]) or re.match(r"\(\?[a-zA-Z]*-?[a-zA-Z]*[aL]", pattern[i:]):
            raise RegexDialectError("ASCII/locale flags have no Java equivalent")
        if ch == "{":
            m = _QUANT.match(pattern, i)
            if m and (m.group(1) or m.group(2)):
                lo = m.group(1) or "0"
                out.append("{" + lo + ("," + m.group(3) if m.group(2) else "") + "}")
                i = m.end()
            else:
                out.append(r"\{")
                i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _check_java(pattern: str) -> None:
    """Compile in the driver's JVM (where there is one), so that a pattern Java rejects fails before any task."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError as e:
        raise RegexDialectError(f"not a pattern of the Java regex engine: {e.java_exception.getMessage()}") from None


def java_regex(pattern: str, ignore_case: bool = False, start: str | None = None) -> str:
    """Validated and translated pattern with the Python-like flag prefix.

    ``start``: a literal that every match begins with; it is looked at before all else, so most places of a line fail at once.
    """
    validate(pattern, ignore_case)
    java = ("(?iUd)" if ignore_case else "(?Ud)") + (f"(?={to_java(re.escape(start))})" if start else "") + to_java(pattern)
    _check_java(java)
    return java


def word_wrap(pattern: str) -> str:
    """Whole-word form used by the reference: ``\\b`` + pattern + ``\\b``, without grouping.

    ``foo|bar`` becomes ``\\bfoo|bar\\b`` (so ``xbar`` matches); a pattern that already
    starts with ``\\b`` is kept as it is.
    """
    return pattern if pattern.startswith(r"\b") else r"\b" + pattern + r"\b"


def glob_to_java(glob: str) -> str:
    """``fnmatch`` pattern as an anchored Java regex over a file's basename."""
    rx = fnmatch.translate(glob)
    if rx.endswith(r"\Z"):
        rx = rx[:-2] + r"\z"
    return "^" + rx


def is_line_local(pattern: str) -> bool:
    """True when a match inside one line is also a match inside the whole text.

    Holds for patterns without anchors, lookaround, atomic groups and possessive
    quantifiers (which could behave differently with more text after the line):
    ``\\b``/``\\B`` see the same neighbours (a line starts after ``\\n`` or at
    the start, ends with its ``\\n`` or at the end).  Used to filter whole
    documents before they are split.
    """
    stripped = re.sub(r"\\.", "", pattern)
    stripped = stripped.replace("[^", "[")
    context_tokens = ("^", "$", "(?=", "(?!", "(?<=", "(?<!", "(?m", "(?s", "(?>", "*+", "++", "?+", "}+")
    return not any(tok in stripped for tok in context_tokens) and not re.search(r"\\[AZzG]", pattern)


def required_literal(pattern: str, ignore_case: bool = False) -> str | None:
    """The longest literal every match of ``pattern`` contains, read from its top-level sequence.

    Uses Python's own regex parser.  Only characters that follow each other at
    the top level count (no alternation, group, class or optional part), so the
    result is always necessary.  ``None`` for ignore-case patterns or when there
    is none.  A ``contains`` on this literal is a cheap guard before ``rlike``.
    """
    if ignore_case:
        return None
    try:
        import re._constants as C
        import re._parser as P

        parsed = P.parse(pattern)
    except Exception:  # noqa: BLE001 - no guard, the regex alone decides
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    best, run = "", []
    for op, arg in parsed.data:
        if op is C.LITERAL:
            run.append(chr(arg))
            continue
        if len("".join(run)) > len(best):
            best = "".join(run)
        run = []
    if len("".join(run)) > len(best):
        best = "".join(run)
    return best or None
