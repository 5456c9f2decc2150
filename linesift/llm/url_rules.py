"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression over the judged form ``host + path`` of a url, together with literal tokens (runs of
``[a-z0-9]``) that every url it fits must hold.  Spark counts how many urls hold each token; a rule is filed under the
rarest of its tokens.  The tokens of a url fetch the rules filed under them, and only those run their regex.  All of
it happens inside the row: no url is shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule, so it gets the
default verdict; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are configuration and travel in the plan; so many at most.
MAX_RULES = 4096
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """Of the rules that fit, the highest rank decides, then the larger name."""

    name: str
    verdict: str  # allow or block
    regex: str  # searched in host + path
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits a host and all its subdomains where the url's path starts with ``path``; longer rules rank higher.

    A path token counts only where the rule's own path ends it: behind an open end a longer token may stand.
    """
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    tokens = re.findall(TOKEN, host.lower()) + re.findall(r"(?<=[/._-])[a-z0-9]+(?=[/._-])", path.lower())
    return Rule(host + path, verdict, rf"^([^/]*\.)?{quoted}", tuple(tokens), 1000 + len(host + path))


def word_rule(word: str) -> Rule:
    """Blocks urls that hold ``word`` between separators."""
    return Rule(f"word:{word}", "block", rf"(^|[./_-]){word}([./_-]|$)", (word,))


#: The rules that the url query is given (fixed values).
HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: Patterns for the urls that no host rule fits: advertising, trackers, forms, downloads.
WORD_RULES = tuple(map(word_rule, "ads adserver banner banners doubleclick tracker login signin logout checkout zip exe iso dmg".split())) + (
    Rule("path:uploads", "block", r"/wp-content/uploads/", ("wp", "content", "uploads")),
    Rule("path:search", "block", r"/search/(index|results)", ("search",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", i), F.lit(""))
    host = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, part(2)


def token_index(forms: DataFrame, rules: Sequence[Rule], form: str = "_form") -> dict[str, list[Rule]]:
    """Rules by their rarest token over all rows of ``forms``; ties go to the smaller token.

    What reaches the driver is one count for each token that occurs in a rule.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.array_distinct(F.filter(url_tokens(F.col(form)), lambda t: t.isin(wanted))) if wanted else F.array().cast("array<string>")
    counts = dict(forms.select(F.explode(held).alias("token")).groupBy("token").count().collect())
    index: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        index[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(r)
    return dict(index)


def url_tokens(form: Column) -> Column:
    return F.regexp_extract_all(F.lower(form), F.lit(f"({TOKEN})"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path`` and ``_rule`` (struct of rank, name, verdict of the deciding rule, or null).

    Columns of ``pages`` named host or path are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = host_and_path(F.col(url))
    forms = pages.withColumns({"host": host, "path": path}).withColumn("_form", F.concat("host", "path"))
    index = token_index(forms, rules)
    rule = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
    if not index:
        return forms.withColumn("_rule", F.lit(None).cast("struct<rank:int,name:string,verdict:string>")).drop("_form")
    filed = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(rule, rs)))])
    keys = F.filter(F.array_distinct(F.concat(url_tokens(F.col("_form")), F.array(F.lit("")))), lambda t: t.isin(sorted(index)))
    fetched = F.flatten(F.transform(keys, lambda t: F.element_at(filed, t)))
    fitting = F.filter(fetched, lambda r: (F.col("host") != "") & F.rlike(F.col("_form"), r["regex"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    return forms.withColumn("_rule", best).drop("_form")


def filter_urls(pages: DataFrame, host_rules: Sequence[Rule] = HOST_RULES, patterns: Sequence[Rule] = WORD_RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern``: ``rule`` is the deciding host rule, ``pattern`` another rule."""
    named = {r.name for r in host_rules}
    out = judge(pages, (*host_rules, *patterns), default=default)
    by_host = F.col("_rule.name").isin(sorted(named)) if named else F.lit(False)
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(by_host, F.col("_rule.name")).alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
        F.when(~by_host, F.col("_rule.name")).alias("pattern"),
    )
