"""URL filters: rules indexed by their rarest literal token.

A rule is a site rule (a host and a path prefix, fitting all subdomains) or a pattern (text
with * for anything and ^ for a separator), each to block or to allow. Every rule becomes a
regular expression and a set of literal tokens. How often each of these occurs is counted over all urls;
the rule is filed under its rarest token. A url looks up the rules filed under its own
tokens, and only their expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
SEPARATOR = r"(?:[^a-zA-Z0-9_.%-]|$)"
#: Bytes of rule text that may go to every executor; split a longer list and combine verdicts.
MAX_RULE_BYTES = 64 << 20


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def tokens_of(text: str) -> set[str]:
    return set(TOKEN.findall(ascii_lower(text)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return ascii_lower(host), slash + path


@dataclass(frozen=True)
class Rule:
    """text is host/path for a site rule, else the pattern. A pattern may begin with || (a host or
    one of its subdomains starts here) or | (the url starts here), end with | (the url ends
    here), or be a regular expression between slashes."""

    text: str
    verdict: str
    site: bool = True
    match_case: bool = False

    @property
    def is_regex(self) -> bool:
        return not self.site and len(self.text) > 2 and self.text[0] == self.text[-1] == "/"

    def _parts(self) -> tuple[str, str, str]:
        """What a pattern begins with, its middle, and what it ends with."""
        body = self.text if self.match_case else ascii_lower(self.text)
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        end = "|" if body.endswith("|") and len(body) > len(start) else ""
        return start, body[len(start) : len(body) - len(end)], end

    @property
    def expression(self) -> str:
        """To search in host + path of a site rule, in the url of a pattern (lower-cased but for match_case)."""
        if self.site:
            host, _, path = self.text.partition("/")
            return rf"\A(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
        if self.is_regex:
            return self.text[1:-1]
        start, body, end = self._parts()
        middle = "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body)
        return {"||": r"\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*\.)?", "|": r"\A", "": ""}[start] + middle + (r"\Z" if end else "")

    @property
    def literals(self) -> list[str]:
        """Tokens that any url it matches has whole: those with a literal neighbour on both sides."""
        if self.site:
            host, _, path = self.text.partition("/")
            # The last token of the path may go on in the url.
            return sorted({*TOKEN.findall(host), *[m[0] for m in TOKEN.finditer(ascii_lower(path)) if m.end() < len(path)]})
        if self.is_regex:
            return []
        start, body, end = self._parts()
        bounded = ("/" if start else "") + ascii_lower(body) + ("/" if end else "")
        return sorted({m[1] for m in re.finditer(r"(?=(?<=[^a-z0-9*])([a-z0-9]+)[^a-z0-9*])", bounded)})


def parse_list(lines: Iterable[str]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules of a filter list in the common blocker syntax, and (line, reason) of those that a url
    alone can't decide: hiding rules, and rules with options that ask for what requested it.

    ! and [ begin comments; @@ makes a rule allow; $match-case is kept, $important and $all
    are as good as none. Null and empty lines are none; repeated rules count once."""
    rules, skipped = {}, []
    for given in lines:
        line = (given or "").strip()
        if not line or line[0] in "![":
            continue
        if re.search(r"#[@?$%]?#", line):
            skipped.append((line, "hides parts of a page"))
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        options: set[str] = set()
        if (cut := re.search(r"\$(~?[\w-]+(?:=[^,]*)?(?:,~?[\w-]+(?:=[^,]*)?)*)$", body)) and not (body[0] == "/" and body[-1] == "/"):
            body, options = body[: cut.start()], set(cut[1].split(","))
        if other := options - {"match-case", "important", "all"}:
            skipped.append((line, "asks for " + ", ".join(sorted(other))))
            continue
        rule = Rule(body, verdict, False, "match-case" in options)
        try:
            re.compile(rule.expression)
        except re.error:
            skipped.append((line, "no regular expression"))
            continue
        if body.strip("*|^"):
            rules[rule] = None
        else:
            skipped.append((line, "fits everything"))
    return list(rules), skipped


def read_list(spark: SparkSession, path: str) -> tuple[list[Rule], list[tuple[str, str]]]:
    """parse_list of text files, which Spark reads; of MAX_RULE_BYTES at most."""
    lines = spark.read.text(path)
    if (lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > MAX_RULE_BYTES:
        raise ValueError(f"rules of over {MAX_RULE_BYTES} bytes: judge them in parts")
    return parse_list(r["value"] for r in lines.collect())


# The rules of the query.
SITE_RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
PATTERN_RULES = (
    Rule(".casino-win.", "block", False), Rule(".cheap-pills.", "block", False), Rule(".ads-track.", "block", False),
    Rule("?utm_source=feed^", "block", False), Rule(".org^*?utm_source=feed^", "allow", False),
)


def counted_tokens(urls: DataFrame, rules: tuple[Rule, ...], url_col: str) -> dict[str, int]:
    """In how many urls each literal token of the rules occurs; over all urls."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    shared = urls.sparkSession.sparkContext.broadcast(frozenset(wanted))  # bounded by MAX_RULE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = dict.fromkeys(shared.value, 0)
        for b in batches:
            for u in b.column(0):
                for t in tokens_of(u.as_py() or "") & shared.value:
                    n[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()))], ["token", "n"])

    rows = urls.select(F.col(url_col).cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


def filed(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[tuple[Rule, re.Pattern]]]:
    """Rules by their rarest token (ties: the longer, then the first by name); under '' those without any."""
    out: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for r in rules:
        rarest = min(r.literals, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        out.setdefault(rarest, []).append((r, re.compile(r.expression, re.S | (re.I if r.is_regex and not r.match_case else 0))))
    return out


def judged(url: str | None, index: dict[str, list[tuple[Rule, re.Pattern]]]) -> tuple[str, str, str | None, str]:
    """host, path, the site rule that decides if any, and the verdict.

    The longest site rule that fits decides (ties: the first by text). Without one, an allowing
    pattern beats blocking ones, a blocking pattern blocks, and all else is allowed."""
    host, path = split_url(url)
    place, low = host + path, ascii_lower(url or "")
    sites, verdicts = [], set()
    for t in (*tokens_of(low), ""):
        for rule, pattern in index.get(t, ()):
            if rule.site:
                if pattern.search(place):
                    sites.append(rule)
            elif pattern.search(url or "" if rule.match_case else low):
                verdicts.add(rule.verdict)
    if sites:
        best = min(sites, key=lambda r: (-len(r.text), r.text))
        return host, path, best.text, best.verdict
    return host, path, None, "block" if "block" in verdicts and "allow" not in verdicts else "allow"


def judge(pages: DataFrame, sites: tuple[Rule, ...] = SITE_RULES, patterns: tuple[Rule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages.

    sites and patterns: rules, as many as MAX_RULE_BYTES hold (see read_list). Null urls and
    urls without :// have an empty host and path; patterns still see the url. Repeated urls
    and ids are judged alike, very long urls whole; an empty table gives no rows; other
    columns play no part."""
    rules = (*sites, *patterns)
    if sum(len(r.text) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"rules of over {MAX_RULE_BYTES} bytes: judge them in parts")
    index = filed(rules, counted_tokens(pages, rules, url_col))
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(u.as_py(), shared.value) for u in b.column(1)]
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
