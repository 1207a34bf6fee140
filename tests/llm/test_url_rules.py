"""URL rules: the index with real counts against running every rule, and filter lists."""

import random

import pytest

from treetally.llm import url_rules
from treetally.llm.url_rules import Rule

D = "/root/testdata/sf0.01"
LIST = """[Blocker 2.0]
! a comment

||ads.example.com^
@@||good.example.com^
|https://start.
/banner/*/img^
.swf|
&ad_id=
/^https?:\\/\\/[a-z]+\\.track\\./
||Case.example.org/Path$match-case
||cdn.example.net^$important
||other.example.net^$third-party,script
example.com##.advert
example.com#@#.advert
/(unclosed/
*
||ads.example.com^
"""


def test_filter_list():
    rules, skipped = url_rules.parse_list([*LIST.split("\n"), None])
    assert [r.text for r in rules] == ["||ads.example.com^", "||good.example.com^", "|https://start.", "/banner/*/img^", ".swf|", "&ad_id=", "/^https?:\\/\\/[a-z]+\\.track\\./", "||Case.example.org/Path", "||cdn.example.net^"]
    assert [r.verdict for r in rules] == ["block", "allow", *["block"] * 7]
    assert [line for line, _ in skipped] == ["||other.example.net^$third-party,script", "example.com##.advert", "example.com#@#.advert", "/(unclosed/", "*"]
    index = url_rules.filed(tuple(rules), {})
    verdict = lambda u: url_rules.judged(u, index)[3]
    blocked = ["http://ads.example.com/x", "https://a.ads.example.com", "https://start.org/", "http://x.org/banner/1/img", "http://x.org/banner/a/b/img?x", "http://x.org/a.swf", "http://x.org/?a=1&ad_id=2", "http://abc.TRACK.org/", "http://Case.example.org/Path", "http://cdn.example.net:80/"]
    allowed = ["http://badads.example.com/x", "http://x.org/?u=ads.example.com", "http://good.example.com/&ad_id=1", "http://start.org/https://start.", "http://x.org/banner/img", "http://x.org/a.swf?x", "http://case.example.org/path", "http://other.example.net/", "", None]
    assert [verdict(u) for u in blocked] == ["block"] * len(blocked)
    assert [verdict(u) for u in allowed] == ["allow"] * len(allowed)


def test_read_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LIST)
    assert set(url_rules.read_list(spark, str(tmp_path))[0]) == set(url_rules.parse_list(LIST.split("\n"))[0])


def many_rules(urls, n):
    """Rules made of pieces of real urls: hosts, paths, queries and cut tokens."""
    rnd, out = random.Random(7), set()
    while len(out) < n:
        u = url_rules.ascii_lower(rnd.choice(urls))
        host, path = url_rules.split_url(u)
        a = rnd.randrange(max(1, len(u) - 8))
        piece = u[a : a + rnd.randint(6, 24)]
        lines = [f"||{host}^", f"||{host}{path}", piece, f"{piece[:5]}*{piece[5:]}", f"|{u[: rnd.randint(8, 30)]}", f"{u[-rnd.randint(4, 12):]}|", f"/{rnd.choice(['seo', 'zz', 'page'])}{rnd.randrange(9999)}^", f"@@{piece}"]
        out.add(rnd.choice(lines))
    return sorted(out)


def test_index_equals_every_rule_with_real_counts(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url")
    urls = [r["url"] for r in pages.where("url is not null").collect()]
    rules, _ = url_rules.parse_list(many_rules(urls, 3000))
    rules = (*url_rules.SITE_RULES, *rules)
    counts = url_rules.counted_tokens(pages, rules, "url")
    plain = {}
    for u in [r["url"] for r in pages.collect()]:
        for t in url_rules.tokens_of(u or ""):
            plain[t] = plain.get(t, 0) + 1
    assert counts == {t: plain.get(t, 0) for r in rules for t in r.literals}
    index = url_rules.filed(rules, counts)
    rarest = {r: t for t, rs in index.items() for r, _ in rs}
    assert all(t == min(r.literals, key=lambda x: (plain.get(x, 0), -len(x), x), default="") for r, t in rarest.items())
    assert any(len(t) < max(map(len, r.literals)) for r, t in rarest.items() if t)  # not just the longest
    every = {"": [x for v in index.values() for x in v]}
    some = urls[::4]
    assert [url_rules.judged(u, index) for u in some] == [url_rules.judged(u, every) for u in some]
    # Rules without a whole token run on every url, as pieces that cut tokens on both sides do.
    ran = sum(len(index.get(t, ())) for u in some for t in (*url_rules.tokens_of(url_rules.ascii_lower(u)), ""))
    assert ran < 0.3 * len(some) * len(rules)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.SITE_RULES, tuple(r for r in rules if not r.site)).collect()}
    assert all(got[r["page_id"]] == url_rules.judged(r["url"], index) for r in pages.collect())


def test_edges(spark):
    schema = "page_id long, url string, host string, rule string, verdict string, token string"
    rows = [(1, "http://a.net/", "x", "y", "z", "t"), (1, "http://a.net/", "x", "y", "z", "t"), (None, "http://a.net/" + "x/" * 100_000, "x", "y", "z", "t"), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r["page_id"]), r["host"], r["rule"], r["verdict"]) for r in url_rules.judge(docs).collect())
    assert got == [("1", "a.net", "net/", "block")] * 2 + [("2", "", None, "allow"), ("None", "a.net", "net/", "block")]
    assert url_rules.judge(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(docs, patterns=(Rule("x" * (url_rules.MAX_RULE_BYTES + 1), "block", False),))
