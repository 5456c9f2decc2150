"""The search itself: line predicates over segments (literal, ignore case, regex, whole word).

``compile_search`` reproduces the reference's pattern building on the driver
(including its ungrouped whole-word wrap and its invalid-regex error); the
predicates are built-in Spark expressions (``contains``, ``lower``, ``rlike``).

``search_corpus`` runs on unsplit text: where a match inside a line implies a
match inside the whole text (always for literals, for regexes without anchors
or lookaround), documents are filtered first, so only candidate documents are
split into lines.  For a literal needle the filter reaches the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.functions.regex import is_line_local, java_regex, required_literal, word_wrap
from linesift.functions.text import rstrip_py, universal_newlines
from linesift.sources.tables import corpus_segments


@dataclass(frozen=True)
class Search:
    """A compiled search: either a literal (``regex is None``) or a Java regex string."""

    needle: str
    ignore_case: bool
    regex: str | None  # Java pattern incl. flags, or None for the literal fast path
    python_pattern: str | None  # the Python pattern the reference would compile
    guard: str | None = None  # a literal every regex match contains (checked first, pushable to Parquet)

    def predicate(self, c: Column | str) -> Column:
        col = F.col(c) if isinstance(c, str) else c
        if self.regex is not None:
            if self.guard is not None:
                return col.contains(self.guard) & col.rlike(self.regex)
            return col.rlike(self.regex)
        if self.ignore_case:
            return F.lower(col).contains(self.needle.lower())
        return col.contains(self.needle)

    def text_prefilter(self, c: Column | str) -> Column | None:
        """A predicate on the whole text that every document with a hit satisfies, or None."""
        if self.regex is None:
            return self.predicate(c)
        if self.guard is not None:  # a line match contains the literal, so its document does too
            col = F.col(c) if isinstance(c, str) else c
            return col.contains(self.guard)
        if self.python_pattern is not None and is_line_local(self.python_pattern):
            return self.predicate(c)
        return None


def compile_search(needle: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> Search:
    """Pattern building as the reference does it (invalid regex -> ``ValueError`` here, on the driver)."""
    text = needle
    if whole_word and not regex:
        text = r"\b" + re.escape(needle) + r"\b"
        regex = True
    if regex:
        final = word_wrap(text) if whole_word else text
        rx = java_regex(final, ignore_case, None if text == needle else needle)
        return Search(needle, ignore_case, rx, final, required_literal(final, ignore_case))
    return Search(needle, ignore_case, None, None)


def _as_search(needle, regex, ignore_case, whole_word) -> Search:
    return needle if isinstance(needle, Search) else compile_search(needle, regex, ignore_case, whole_word)


def grep(
    segments: DataFrame,
    needle: str | Search,
    regex: bool = False,
    ignore_case: bool = False,
    whole_word: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Segments -> hits.  One hit per matching segment (not per match).

    Text lines are tested with their terminator and emitted right-stripped;
    Office segments (non-empty ``location_display``) are emitted unchanged.
    """
    s = _as_search(needle, regex, ignore_case, whole_word)
    hits = segments.where(s.predicate("raw"))
    content = F.when(F.col("location_display") == "", rstrip_py(F.col("raw"))).otherwise(F.col("raw"))
    return hits.select(
        "file_path",
        content.alias("line_content"),
        "line_number",
        "location_display",
        "metadata",
        *keep,
    )


def search_corpus(
    corpus: DataFrame,
    needle: str | Search,
    regex: bool = False,
    ignore_case: bool = False,
    whole_word: bool = False,
    keep: tuple[str, ...] = (),
    prefilter: bool = True,
) -> DataFrame:
    """Text corpus (``file_path, text``) -> hits, filtering whole documents first when that is exact."""
    s = _as_search(needle, regex, ignore_case, whole_word)
    if prefilter:
        cond = document_may_match(s)
        if cond is not None:
            corpus = corpus.where(cond)
    segments = corpus_segments(corpus, keep=keep)
    return grep(segments, s, keep=keep)


def document_may_match(s: Search) -> Column | None:
    """A test on the whole ``text`` that every document with a hit passes (``None`` if there is none).

    Literals and guard literals without newlines test the raw column (pushed to
    Parquet); other line-local regexes test the newline-normalised text.
    """
    if s.regex is None and s.needle == "":
        return None  # the empty needle matches every line
    pre = s.text_prefilter("text")
    plain = s.guard if s.regex is not None else s.needle
    if plain is not None and "\r" not in plain and "\n" not in plain:
        # newline conversion only touches \r, so the raw text column decides (and is pushed to Parquet)
        return pre
    if pre is not None:
        return s.predicate(universal_newlines(F.col("text")))
    return None
