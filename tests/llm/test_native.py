"""URL filter and sharding."""

import re
import zlib
from collections import Counter

from linesift.llm import sharding, url_rules

URLS = ["https://www.example.com/en/1", "http://a.www.EXAMPLE.com/en/x?q#f", "https://blog.example.com/en/9", "https://x.example.com/de/1", "http://example.com", "http://example.com?x/en/", "https://net/es/1", "https://a.net/fr/", "https://a.net/FR/", "https://notexample.com/en/1", "https://a.org/ads/x", "https://a.org/wp-content/uploads/q", "no scheme", "", None, "a://b.com/x://c.net/es/", "https://ads.example.org/x", "https://a.net/es", "https://com/en/1", "http://a.org/x.zip"]


def judged(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [r for r in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/") if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    rule = max(fits, key=len, default=None)
    pattern = any(re.search(r.regex, host + path) for r in url_rules.WORD_RULES) and host != ""
    verdict = ("allow" if rule in ("com/", "www.example.com/en/") else "block") if rule else "block" if pattern else "allow"
    return host, path, rule, verdict


def test_urls(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(df).collect()}
    assert got == {i: judged(u) for i, u, *_ in rows}
    assert url_rules.filter_urls(df.limit(0)).count() == 0


def test_rarest_token_and_rules_without_one(spark):
    df = spark.createDataFrame([(f"h{i}.common/rare" if not i else f"h{i}.common/x",) for i in range(5)], "_form string")
    both, none = url_rules.Rule("r", "block", "rare", ("common", "rare")), url_rules.Rule("n", "block", "^h3", ())
    assert set(url_rules.token_index(df, [both, none])) == {"rare", ""}
    pages = spark.createDataFrame([(1, "a://h3.common/x")], "page_id long, url string")
    assert url_rules.filter_urls(pages, (), (both, none)).first()["pattern"] == "n"
    assert url_rules.filter_urls(pages, (), ()).first()["verdict"] == "allow"


def test_permutation_is_one_to_one_and_can_be_turned_round():
    for n in (1, 2, 3, 10, 97, 1000, 1009):
        assert sorted(sharding.permute(i, n) for i in range(n)) == list(range(n))
        assert all(sharding.row_of_place(*sharding.place_of_row(i, n, 16), n, 16) == i for i in range(n))


def test_shards(spark, hard, hard_rows, none):
    got = sharding.shard_rows(hard.withColumnRenamed("source", "size"), 16).collect()
    n = len(hard_rows)
    want = Counter((k, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for k, t, *_ in hard_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((i % 16, i // 16) for i in range(n))
    assert all(sharding.place_of_row(r["row"], n, 16) == (r["shard"], r["slot"]) for r in got)
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["row"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sharding.shard_rows(none).count() == 0
