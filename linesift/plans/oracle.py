"""DuckDB SQL for every registered query with a SQL form (the correctness oracle).

DuckDB uses RE2, where ``\\b \\w \\d \\s`` are ASCII; the oracle therefore spells
Python's Unicode classes out (``\\p{L}\\p{N}_`` for word characters) and
writes ``\\b`` as "non-word character or text edge" around the match.
"""

from __future__ import annotations

from linesift.plans import params as P
from linesift.sources.presets import preset_list

W = r"\p{L}\p{N}_"  # Python's word characters
NOT_W = "[^" + W + "]"
LEFT_B = "(^|" + NOT_W + ")"
RIGHT_B = "($|" + NOT_W + ")"
# Python's white space, and a line with its end; written out here, so that the oracle stands by itself.
SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_PIECE = r"[^\n]*\n|[^\n]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


DOC_PATH = "concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt')"
PAGE_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)', 1)"
CONV_PATH = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt'"
BENCH_PATH = "CAST(item_id AS VARCHAR) || '.txt'"

CORPUS_SQL = {
    "documents": ("documents", DOC_PATH, "text"),
    "pages": ("pages", PAGE_PATH, "html"),
    "conversations": ("conversations", CONV_PATH, "text"),
    "benchmark": ("benchmark", BENCH_PATH, "text"),
}


def lines(corpus: str = "documents", where: str = "TRUE", path: str | None = None, extra: tuple[str, ...] = (), table: str | None = None) -> str:
    """Subquery ``file_path, [extra...], raw, line_number`` of a corpus (universal newlines, terminator kept).

    ``path`` and ``table`` replace the corpus's path expression and table; ``extra`` are source columns carried along.
    """
    given, default_path, text = CORPUS_SQL[corpus]
    norm = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    carried = "".join(f"{c}, " for c in extra)
    return (
        f"(SELECT file_path, {carried}unnest(l) AS raw, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_number "
        f"FROM (SELECT {path or default_path} AS file_path, {carried}regexp_extract_all({norm}, {q(LINE_PIECE)}) AS l "
        f"FROM {table or given} WHERE {where}))"
    )


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, {q(SPACE + '+$')}, '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def rx(c: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_matches({c}, {q(pattern)}{', ' + q('i') if ci else ''})"


def hits(pred: str, corpus: str = "documents") -> str:
    return f"SELECT file_path, line_number, {rstrip('raw')} AS line_content FROM {lines(corpus)} WHERE {pred}"


def preset_re2(pattern: str) -> str:
    """A preset's pattern in RE2 form: Python's Unicode classes and word edges spelled out, all else as it is listed."""
    inside = {"w": W, "d": r"\p{Nd}"}
    out, at, in_class = "", 0, False
    while at < len(pattern):
        c, following = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\":
            if following in inside:
                out += inside[following] if in_class else f"[{inside[following]}]"
            elif following == "s":
                out += SPACE
            elif following == "b":
                out += RIGHT_B if at + 2 == len(pattern) else LEFT_B
            elif following == "u":
                out += r"\x{" + pattern[at + 2 : at + 6] + "}"
                at += 4
            else:
                out += c + following
            at += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out, at = out + c, at + 1
    return out


PRESET_RE2 = {label: preset_re2(pattern) for _category, _ord, label, pattern, _r in preset_list()}


def _preset_scan_sql() -> str:
    parts = []
    for corpus in CORPUS_SQL:
        for category, _ord, label, _pat, _r in preset_list():
            parts.append(
                f"SELECT {q(corpus)} AS corpus, file_path, line_number, {q(category)} AS category, {q(label)} AS label "
                f"FROM {lines(corpus)} WHERE {rx('raw', PRESET_RE2[label])}"
            )
    return "\nUNION ALL\n".join(parts)


def _word_ci_hits() -> str:
    return hits(rx("raw", LEFT_B + P.NEEDLE_CI.lower() + RIGHT_B, ci=True))


def _tree_files() -> str:
    pre = " ".join(f"WHEN {q(k)} THEN {q(p)}" for k, (p, _s) in P.TREE_NAMES.items())
    suf = " ".join(f"WHEN {q(k)} THEN {q(s)}" for k, (_p, s) in P.TREE_NAMES.items())
    doc = (
        f"SELECT concat_ws('/', source, lang, (CASE source {pre} ELSE '' END) || CAST(doc_id AS VARCHAR) "
        f"|| (CASE source {suf} ELSE '.txt' END)) AS file_path FROM documents"
    )
    files = f"(SELECT file_path FROM ({doc}) UNION ALL SELECT {PAGE_PATH} AS file_path FROM pages)"
    base = "regexp_extract(file_path, '[^/]*$', 0)"
    return (
        f"(SELECT file_path, base_name, lower(regexp_extract(base_name, {q(r'^\.*[^.].*(\.[^.]*)$')}, 1)) AS ext, "
        f"dirs_list FROM (SELECT file_path, {base} AS base_name, "
        f"string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1] AS dirs_list FROM {files}))"
    )


def _in_list(col: str, values) -> str:
    vals = ", ".join(q(v) for v in values)
    return f"{col} IN ({vals})" if values else "FALSE"


def _glob_none(col: str, globs) -> str:
    return " AND ".join(f"NOT ({col} GLOB {q(g)})" for g in globs) or "TRUE"


def _dirs_none(values) -> str:
    if not values:
        return "TRUE"
    return "NOT list_has_any(dirs_list, [" + ", ".join(q(v) for v in values) + "])"


def _prune_sql(dirs=(), exts=(), globs=()) -> str:
    ext_cond = f"NOT {_in_list('ext', exts)}" if exts else "TRUE"
    return f"SELECT file_path FROM {_tree_files()} WHERE {_dirs_none(dirs)} AND {ext_cond} AND {_glob_none('base_name', globs)}"


def build() -> dict[str, str]:
    # The exclusions that plans/params.py must come down to are written out, as results.
    ws_word = lambda n, ci=False: rx("raw", LEFT_B + n + RIGHT_B, ci)
    sql = {
        "scan_lines": f"SELECT file_path, line_number, raw FROM {lines()}",
        "grep_literal": hits(f"contains(raw, {q(P.NEEDLE)})"),
        "grep_empty": hits("TRUE"),
        "grep_literal_ci": hits(f"contains(lower(raw), {q(P.NEEDLE_CI.lower())})"),
        "grep_regex": hits(rx("raw", P.REGEX)),
        "grep_regex_ci": hits(rx("raw", P.REGEX_CI, ci=True)),
        "grep_word": hits(ws_word(P.NEEDLE)),
        "grep_word_ci": hits(ws_word(P.NEEDLE_CI.lower(), ci=True)),
        "grep_word_regex": hits(rx("raw", LEFT_B + P.WORD_REGEX + RIGHT_B)),
        "grep_trailing_space": hits(rx("raw", PRESET_RE2["Trailing Space"])),
        "grep_rstrip": hits(f"contains(raw, {q(P.RSTRIP_NEEDLE)})", "conversations"),
        "grep_preset_ipv4": hits(rx("raw", PRESET_RE2["IPv4 Address"])),
        "grep_preset_email": hits(rx("raw", PRESET_RE2["Email Address"])),
        "preset_scan": _preset_scan_sql(),
        "preset_scan_join": _preset_scan_sql(),
        "pattern_index_scan": (
            "WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS x FROM benchmark), "
            f"l AS (SELECT file_path, line_number, raw FROM {lines('documents')}), "
            f"found AS (SELECT DISTINCT file_path, line_number, unnest(regexp_extract_all(raw, '[{W}]+')) AS x FROM l), "
            "pieces AS (SELECT file_path, line_number, unnest(string_split(raw, ' ')[2:]) AS p FROM l), "
            "starts AS (SELECT DISTINCT file_path, line_number, left(p, k) AS x FROM (SELECT *, unnest(range(6, length(p) + 1, 2)) AS k FROM pieces)) "
            "SELECT x AS label, count(*) AS hits FROM (SELECT x FROM found WHERE length(x) % 2 = 1 UNION ALL SELECT x FROM starts) JOIN words USING (x) GROUP BY x"
        ),
        "preset_counts": (
            "SELECT p.category, p.label, CAST(coalesce(c.hits, 0) AS BIGINT) AS hits FROM (VALUES "
            + ", ".join(f"({q(c)}, {q(l)})" for c, _o, l, _p, _r in preset_list())
            + ") AS p(category, label) LEFT JOIN (SELECT category, label, count(*) AS hits FROM ("
            + _preset_scan_sql()
            + ") GROUP BY category, label) c ON p.category = c.category AND p.label = c.label"
        ),
        "hit_count": f"SELECT count(*) AS hits FROM ({_word_ci_hits()})",
        "hits_per_file": f"SELECT file_path, count(*) AS hits FROM ({_word_ci_hits()}) GROUP BY file_path",
        "display_rows": (
            "SELECT file_path, regexp_extract(file_path, '[^/]*$', 0) AS file, CAST(line_number AS VARCHAR) AS line, "
            f"line_content AS content FROM ({_word_ci_hits()})"
        ),
        "display_truncate": (
            "SELECT file_path || ':' || CAST(line_number AS VARCHAR) AS \"where\", "
            f"CASE WHEN length({strip('line_content')}) > 120 THEN substring({strip('line_content')}, 1, 120) || '...' "
            f"ELSE {strip('line_content')} END AS content FROM ({_word_ci_hits()})"
        ),
        "files_with_hits": (
            f"SELECT {DOC_PATH} AS file_path FROM documents d WHERE {DOC_PATH} IN "
            f"(SELECT file_path FROM ({hits(rx('raw', P.REGEX))}))"
        ),
        "files_without_hits": (
            f"SELECT {DOC_PATH} AS file_path FROM documents d WHERE {DOC_PATH} NOT IN "
            f"(SELECT file_path FROM ({hits(rx('raw', P.REGEX))}))"
        ),
        "first_n_hits": f"SELECT * FROM ({_word_ci_hits()}) ORDER BY file_path, line_number LIMIT {P.FIRST_N}",
        "scan_summary": (
            "SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS files, "
            f"CAST((SELECT count(*) FROM {lines()}) AS BIGINT) AS segments, "
            f"CAST((SELECT count(*) FROM ({hits(rx('raw', P.REGEX))})) AS BIGINT) AS hits, "
            f"CAST((SELECT count(DISTINCT file_path) FROM ({hits(rx('raw', P.REGEX))})) AS BIGINT) AS files_with_hits, "
            "CAST(0 AS BIGINT) AS errors"
        ),
        "split_path": (
            "SELECT file_path, base_name, ext, array_to_string(dirs_list, '/') AS dirs, "
            f"CAST(len(dirs_list) AS INTEGER) AS n_dirs FROM {_tree_files()}"
        ),
        "exclude_dirs": _prune_sql(dirs=["src1", "fr", "blog.ththan.example.net"]),
        "exclude_exts": _prune_sql(exts=[".log", ".md", ".gz"]),
        "exclude_globs": _prune_sql(globs=P.EXCLUDE_GLOBS),
        "exclude_combined": _prune_sql(exts=[".png"], globs=P.COMBINED_CALL_GLOBS),
        "exclude_ext_groups": _prune_sql(exts=[".txt", ".zip", ".tar", ".gz", ".rar", ".7z", ".log", ".bak", ".tmp", ".pyc", ".pyo"]),
        "exclude_union": _prune_sql(dirs=["en", "src2", "src5"], exts=[".csv", ".json", ".log"]),
        "history_recent": (
            "SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM events "
            "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 "
            "ORDER BY ts DESC, event_id DESC LIMIT 50"
        ),
    }
    return sql


ORACLE_SQL = build()
