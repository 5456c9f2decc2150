"""Line predicates against the reference's fixtures, edge rows and a pure-Python model."""

import io
import random
import re

import pytest

from conftest import segments_of
from linesift.functions.regex import glob_to_java, is_line_local, java_regex, to_java
from linesift.operators.grep import compile_search, grep, search_corpus

UTF8_TEXT = "Hello World\nこれはテストです\nPython Grep"  # three lines, no final newline


def model(text, needle, regex=False, ignore_case=False, whole_word=False):
    """The reference's line loop, in plain Python."""
    search = needle
    if whole_word and not regex:
        search = r"\b" + re.escape(needle) + r"\b"
        regex = True
    pattern = None
    if regex:
        final = r"\b" + search + r"\b" if whole_word and not search.startswith(r"\b") else search
        pattern = re.compile(final, re.IGNORECASE if ignore_case else 0)
    out = []
    for i, line in enumerate(io.StringIO(text, newline=None), 1):
        if pattern is not None:
            hit = bool(pattern.search(line))
        elif ignore_case:
            hit = search.lower() in line.lower()
        else:
            hit = search in line
        if hit:
            out.append((i, line.rstrip()))
    return out


def run(spark, text, needle, **opts):
    hits = grep(segments_of(spark, [("f.txt", text)]), needle, **opts)
    return sorted((r.line_number, r.line_content) for r in hits.collect())


def test_literal_line_number(spark):
    assert run(spark, UTF8_TEXT, "Python") == [(3, "Python Grep")]


def test_regex_two_hits(spark):
    assert [n for n, _ in run(spark, UTF8_TEXT, "World|テスト", regex=True)] == [1, 2]


def test_japanese_literal(spark):
    assert run(spark, UTF8_TEXT, "テスト") == [(2, "これはテストです")]


@pytest.mark.parametrize(
    "text,needle,opts",
    [
        ("a\r\nb\rc\nd", "b", {}),
        ("a\r\nb\rc\nd", r"^c$", {"regex": True}),
        ("x  \t\n", r"\s+$", {"regex": True}),
        ("", "", {}),
        ("one\ntwo", "", {}),
        ("xbar foo\nbarx\n", "foo|bar", {"regex": True, "whole_word": True}),
        ("İstanbul\nSTRASSE ß\n", "i̇stanbul", {"ignore_case": True}),
        ("a.b a*b\nq\\E\n", "a.b", {"whole_word": True}),
        ("a.b a*b\nq\\E\n", "\\E", {}),
        ("x # y\n", "# y", {"whole_word": True}),
        ("tail more\nend\u0085x\n", "more", {}),
        ("trail　\nsep\u001c\n", "trail", {}),
        ("１２３ ٣\n", r"\d+", {"regex": True}),
        ("The the THE\n", "the", {"ignore_case": True, "whole_word": True}),
        ("naïve café\n", "café", {"whole_word": True}),
    ],
)
def test_edge_rows(spark, text, needle, opts):
    assert run(spark, text, needle, **opts) == model(text, needle, **opts)


def test_invalid_regex_fails_on_driver():
    with pytest.raises(ValueError, match="Invalid regular expression"):
        compile_search("(unclosed", regex=True)


def test_random_against_model(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", " ", "\n", "\r", ".", "é", "_", "1", "B", "\t"]
    needles = ["a", "ab", "b a", "B", "é", ".", "a.b", "1"]
    regexes = [r"a+b", r"\bab\b", r"[ab]{2}", r"^a", r"b$", r"\s+$", r"a|b", r"\w+é", r"(a)\1"]
    for _ in range(25):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.5:
            needle, opts = rnd.choice(needles), {"ignore_case": rnd.random() < 0.5, "whole_word": rnd.random() < 0.3}
        else:
            needle, opts = rnd.choice(regexes), {"regex": True, "ignore_case": rnd.random() < 0.5, "whole_word": rnd.random() < 0.3}
        assert run(spark, text, needle, **opts) == model(text, needle, **opts), (text, needle, opts)


def test_document_prefilter_keeps_results(spark):
    docs = spark.createDataFrame([("a.txt", "foo\nbar"), ("b.txt", "baz\r\nfoo bar"), ("c.txt", "none")], "file_path string, text string")
    for needle, opts in [("foo", {}), ("FOO", {"ignore_case": True}), ("ba[rz]", {"regex": True}), ("^bar", {"regex": True})]:
        with_pre = sorted(tuple(r) for r in search_corpus(docs, needle, **opts).select("file_path", "line_number").collect())
        without = sorted(tuple(r) for r in search_corpus(docs, needle, prefilter=False, **opts).select("file_path", "line_number").collect())
        assert with_pre == without


def test_dialect_translation():
    assert to_java(r"(?P<w>ab)(?P=w)") == r"(?<w>ab)\k<w>"
    assert to_java(r"a\Z") == r"a\z"
    assert to_java(r"a{,3}") == r"a{0,3}"
    assert to_java(r"a{") == r"a\{"
    assert to_java(r"[[&]") == r"[\[\&]"
    assert java_regex("x", ignore_case=True).startswith("(?iUd)")
    assert is_line_local("foo|bar") and not is_line_local("^foo") and is_line_local("[^>]+")


def test_glob_translation_matches_fnmatch(spark):
    import fnmatch

    from pyspark.sql import functions as F

    names = ["a.txt", ".env", "a.", "a.tar.gz", ".x.log", "old.bak", "abc", "[x].txt", "x?y", "A.TXT", "a\nb.txt"]
    globs = ["*.txt", "*.bak", "?.*", "[!a]*", "[a-c]*", "*.tar.*", "[x].txt", "x[?]y", ".*"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for g in globs:
        got = sorted(r.n for r in df.where(F.col("n").rlike(glob_to_java(g))).collect())
        want = sorted(n for n in names if fnmatch.fnmatchcase(n, g))
        assert got == want, g


def test_required_literal_is_necessary():
    """Whenever the regex matches, the guard literal is in the text (random patterns and texts)."""
    from linesift.functions.regex import required_literal
    from linesift.sources.presets import preset_list

    rnd = random.Random(11)
    atoms = ["a", "b", "ab", "[ab]", "a?", "b*", "(a|b)", "\\.", ".", "x", "(?:ab)+", "\\b", "^", "$", "\\d"]
    patterns = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    patterns += [p[3] for p in preset_list()]
    texts = ["".join(rnd.choice("abx.1 \n") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    for p in patterns:
        lit = required_literal(p)
        if lit is None:
            continue
        rx = re.compile(p)
        for t in texts:
            if rx.search(t):
                assert lit in t, (p, lit, t)


def test_translated_constructs_against_python(spark):
    """Patterns that need translating to Java give the same lines as Python's re."""
    texts = ("abab x\nab{ ba\nx\x1cy z\nfoo&bar [q]\nend abab", "aaa\nab\n{,2}\nnothing")
    patterns = [
        r"(?P<w>ab)(?P=w)", r"a{,2}b", r"b\Z", r"ab{", r"[&\[]", r"x\sy", r"\S+\s\S+$",
        r"(?<=a)b", r"(?<!a)b", r"a++b", r"(?:ab)?+x", r"[^\s]z", r"o{1,}&",
    ]
    for text in texts:
        for p in patterns:
            assert run(spark, text, p, regex=True) == model(text, p, regex=True), (p, text)


def test_ignore_case_regex_unicode_against_python(spark):
    text = "Élan\nélan\nSTRASSE\nstraße\nKelvin\nkelvin\nſun\nsun\nΣΑΣ σας\n"
    for p in [r"élan", r"strasse", r"kelvin", r"sun", r"σας", r"\bÉ\w+"]:
        assert run(spark, text, p, regex=True, ignore_case=True) == model(text, p, regex=True, ignore_case=True), p
