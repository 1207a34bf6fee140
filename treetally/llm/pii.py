"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (email, ip, card, phone) always stand. Beyond them, wide candidate patterns
propose spans of further kinds (secret, idnum, name), and six labelers (two of form, two
gazetteers, two of context) vote for, against or not at all. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is; its posteriors are the
soft labels that train the final span classifier, a logistic model on votes, kind, length and
variety. Counts of patterns have a size bound of their own (see MAX_PATTERNS); only they reach
the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "idnum", "name")
KINDS = BASE + EXTRA

# The patterns of the base kinds. Possessive where nothing that follows could
# need characters back, and tied to the start of a run where a later start in the same run
# fails as well, so that long runs take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    # Runs of fewer digits are never valid, and a run is matched whole or not at all.
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{20,}+",
    "idnum": r"(?<![0-9A-Za-z.+-])[0-9]{3}[ .-][0-9]{2,3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?<!\p{L})(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: A text without a match of this has none of the kind: a cheap test before the pattern.
NEEDS = {"email": "@", "phone": "+"}

# Gazetteers, matched against the text just before a candidate or in it.
SECRET_WORDS = (
    "access key", "access token", "api key", "api_key", "apikey", "auth", "auth token", "authorization", "bearer", "client secret", "client_secret", "cookie",
    "credential", "credentials", "encryption key", "geheimnis", "jwt", "kennwort", "key", "license key", "login", "mot de passe", "oauth", "passcode", "passphrase",
    "passwd", "password", "passwort", "pin", "private key", "pwd", "refresh token", "schluessel", "secret", "secret key", "session", "sessionid", "signature", "token", "webhook",
)
ID_WORDS = (
    "account", "account number", "ausweis", "cell", "cell phone", "cellphone", "celular", "driver license", "fax", "handy", "id number", "identity", "insurance number", "konto",
    "medical record", "mobil", "mobile", "movil", "national id", "numero de securite sociale", "passport", "passport number", "phone", "phone number", "policy number", "social",
    "social security", "social security number", "ssn", "steuernummer", "tax id", "tel", "telefon", "telefono", "telephone", "tfno", "whatsapp",
)
PERSON_WORDS = (
    "amicalement", "approved by", "attention", "attn", "author", "by", "call", "cc", "contact", "contacto", "cordialement", "customer", "dear", "editor", "email", "from",
    "gruss", "hello", "i am", "ich bin", "je m'appelle", "manager", "me llamo", "mein name ist", "met", "mit", "mi nombre es", "my name is", "owner", "patient", "regards",
    "reviewed by", "saludos", "signed", "signed by", "sincerely", "soy", "speaker", "von", "with", "written by", "yours truly",
)
OTHER_WORDS = (
    "artikel", "asin", "build", "bug", "chapter", "checksum", "commit", "digest", "doi", "ean", "edition", "etag", "fig", "figure", "file", "hash", "invoice", "isbn", "issn",
    "issue", "item", "kapitel", "lot", "md5", "model", "no", "nr", "num", "order", "page", "part", "part number", "product", "release", "rev", "revision", "section",
    "seite", "serial", "sha", "sha1", "sha256", "sku", "table", "ticket", "upc", "uuid", "version", "volume",
)
FIRST_NAMES = (
    "adam", "aisha", "alan", "alejandro", "alex", "alexander", "alice", "amanda", "amelia", "ana", "andrea", "andreas", "andrew", "angela", "anna", "anne", "anthony", "antonio",
    "barbara", "ben", "bernd", "brian", "camille", "carla", "carlos", "carmen", "carol", "catherine", "charles", "charlotte", "chiara", "chloe", "chris", "christian", "christine",
    "claire", "clara", "claudia", "daniel", "david", "deborah", "diego", "dieter", "edward", "elena", "elizabeth", "emily", "emma", "eric", "eva", "fatima", "felix", "fernando",
    "francesca", "francisco", "francois", "frank", "gabriel", "george", "giulia", "grace", "hannah", "hans", "heidi", "helen", "henry", "hugo", "ines", "isabel", "ivan", "jack",
    "jacques", "james", "jan", "jane", "javier", "jean", "jennifer", "jessica", "joao", "john", "jonas", "jose", "joseph", "juan", "julia", "julie", "karen", "karl", "katharina",
    "kenji", "kevin", "klaus", "laura", "lea", "leon", "linda", "lisa", "louis", "lucas", "lucia", "luis", "luke", "manuel", "marco", "margaret", "maria", "marie", "mario",
    "mark", "marta", "martin", "mary", "mateo", "matthew", "max", "mei", "michael", "michel", "miguel", "mohammed", "monica", "nadia", "natalie", "nicolas", "nina", "oliver",
    "olivia", "pablo", "patricia", "patrick", "paul", "pedro", "peter", "philippe", "pierre", "priya", "rachel", "rafael", "raj", "rebecca", "ricardo", "richard", "robert", "rosa",
    "ruth", "samuel", "sandra", "sara", "sarah", "sergio", "sofia", "sophie", "stefan", "stephen", "steven", "susan", "sven", "thomas", "timothy", "tom", "ursula", "victor",
    "walter", "wei", "william", "wolfgang", "yuki", "yusuf", "zoe",
)


@dataclass(frozen=True)
class Gazetteers:
    """What the two gazetteer labelers and the first of context look up. Part of the plan, so of
    a caller's size (thousands of entries), never of the data's."""

    secret_words: tuple[str, ...] = SECRET_WORDS
    id_words: tuple[str, ...] = ID_WORDS
    person_words: tuple[str, ...] = PERSON_WORDS
    other_words: tuple[str, ...] = OTHER_WORDS
    first_names: tuple[str, ...] = FIRST_NAMES


#: Entries of all lists that read_gazetteers takes: they are part of each task's plan.
MAX_ENTRIES = 20_000


def read_gazetteers(entries: DataFrame, list_col: str = "list", entry_col: str = "entry", base: Gazetteers | None = Gazetteers()) -> Gazetteers:
    """The gazetteers that a table of (list, entry) names, added to those of base (None: alone).

    list is the name of a list of Gazetteers, in any case; another name raises. Entries are
    lower-cased and trimmed, white space within counts as one space; null and empty ones and
    repeats are nothing, and an entry longer than WINDOW could never match, so it raises, but for
    first names, which aren't looked for in the window. More than MAX_ENTRIES distinct entries
    raise. Other columns play no part; an empty table gives base."""
    entry = F.btrim(F.regexp_replace(F.lower(F.col(entry_col).cast("string")), r"\s+", " "))
    rows = entries.select(F.lower(F.btrim(F.col(list_col).cast("string"))).alias("list"), entry.alias("entry")).where("list is not null and entry <> ''")
    rows = rows.distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    names = [f.name for f in fields(Gazetteers)]
    if unknown := sorted({r["list"] for r in rows} - set(names)):
        raise ValueError(f"no such lists: {', '.join(unknown)}")
    if long := sorted(r["entry"] for r in rows if len(r["entry"]) > WINDOW and r["list"] != "first_names"):
        raise ValueError(f"longer than {WINDOW} code points: {', '.join(long[:10])}")
    own = {n: {r["entry"] for r in rows if r["list"] == n} for n in names}
    return Gazetteers(**{n: tuple(sorted(own[n] | set(getattr(base, n) if base else ()))) for n in names})


#: Code points before a candidate that labelers see.
WINDOW = 24
LABELERS = ("form", "malformed", "listed", "listed_other", "cue", "counter_cue")
#: Vote patterns: kinds x 3 votes of 6 labelers x 4 lengths x 2 varieties.
MAX_PATTERNS = len(EXTRA) * 3 ** len(LABELERS) * 8


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running op (sum, maximum ...; the second argument may be null) over an array, by doubling
    shifts: log2 of its size passes, each of which makes one new array."""
    last = F.greatest(F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1, F.lit(0))
    pass_ = lambda acc, k: F.transform(acc, lambda v, i: op(v, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))))
    return F.aggregate(F.sequence(F.lit(0), last), values, pass_)


def _some(text: Column, kind: str) -> Column:
    if kind in NEEDS:
        return F.instr(text, NEEDS[kind]) > 0
    return F.lit(True) if kind == "name" else text.rlike("[0-9]")


def _cut(text: Column, kind: str) -> Column:
    """array<struct<m,b>>: each match and what lies between it and the one before; last, a null
    match and the text after all."""
    found, between = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    return F.when(_some(text, kind), F.arrays_zip(found.alias("m"), between.alias("b"))).otherwise(F.expr("cast(array() as array<struct<m:string,b:string>>)"))


def _ends(cut: Column) -> Column:
    """Where each entry of _cut ends; code points."""
    return _running(F.transform(cut, lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda v, w: v + F.coalesce(w, F.lit(0)))


def _matches(cut: Column, ends: Column) -> Column:
    """array<struct<start,end,text,before>>, leftmost and non-overlapping; code points, end exclusive."""
    placed = F.zip_with(cut, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("text"), F.right(x["b"], F.lit(WINDOW)).alias("before")))
    return F.filter(placed, lambda m: m["text"].isNotNull())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum holds: each second digit from the right counts double, less 9 over 9."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))

    def add(acc: Column, digit: Column) -> Column:
        d = digit.cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(acc["i"] % 2 == 1, doubled).otherwise(d)).alias("sum"))

    return F.aggregate(F.reverse(F.split(digits, "")), start, add)["sum"] % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(text)).between(12, 19), _luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, text: Column, before: Column, listed: Gazetteers) -> list[Column]:
    """1, -1 or 0 of each labeler. before is lower case."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    no = lambda c: F.when(c, -1).otherwise(0)
    just = lambda words: before.rlike(rf"(?<![a-z])(?:{'|'.join(map(re.escape, words))})[\s:=.\"'#-]*$") if words else F.lit(False)
    other = no(just(listed.other_words))
    counter = no(before.rlike(r"(?:https?://\S*|[/&?@])$"))
    varied = F.size(F.array_distinct(F.split(text, "")))
    if kind == "secret":
        return [yes(text.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$|^(?:sk-|ghp_|AKIA|xox)")),
                no((varied < 8) | ~text.rlike("[A-Za-z]") | text.rlike("^[A-Za-z_-]*[0-9]{1,4}$")),
                yes(just(listed.secret_words)), other, yes(before.rlike(r"[:=]\s*[\"']?$")), counter]
    if kind == "idnum":
        return [yes(text.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")),
                no((varied < 4) | text.rlike("^000|0000$")), yes(just(listed.id_words)), other, yes(before.rlike(r"[:=#]\s*$")), counter]
    return [yes(text.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$")), no(F.length(text) < 6),
            yes(F.lower(F.regexp_extract(text, r" (\p{Lu}\p{Ll}+)", 1)).isin(*listed.first_names)), other, yes(just(listed.person_words)), no(before.rlike(r"[0-9]\s*$"))]


def _base_spans(kind: str, rank: int) -> Column:
    good = F.filter(f"_{kind}", lambda m: _valid(kind, m["text"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _candidates(kind: str, rank: int, listed: Gazetteers) -> Column:
    def struct(m: Column) -> Column:
        votes = _votes(kind, m["text"], F.lower(m["before"]), listed)
        varied = F.size(F.array_distinct(F.split(m["text"], "")))
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                        F.array(*votes).alias("votes"), F.least(F.floor(F.length(m["text"]) / 16).cast("int"), F.lit(3)).alias("length"), (varied >= 10).cast("int").alias("varied"))

    return F.transform(f"_{kind}", struct)


def _apart(candidates: Column, base: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """Events, and from events and their reach (the running maximum of their ends) those
    candidates that overlap no base span: no base span that starts before a candidate
    ends has an end after the candidate's start. Both are merged in one order (a candidate by
    its end, before a base span that starts there) under a running maximum of base ends."""
    none = F.expr("cast(null as struct<start:int,rank:int,end:int,kind:string,votes:array<int>,length:int,varied:int>)")
    event = lambda key, is_base, end, c: F.struct(key.alias("key"), F.lit(is_base).alias("is_base"), end.alias("end"), c.alias("c"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 1, b["end"], none)), F.transform(candidates, lambda c: event(c["end"], 0, F.lit(0), c))))
    return events, lambda events, reach: F.transform(F.filter(F.arrays_zip(events.alias("e"), reach.alias("r")), lambda x: (x["e"]["is_base"] == 0) & (x["r"] <= x["e"]["c"]["start"])), lambda x: x["e"]["c"])


def _with_spans(docs: DataFrame, text_col: str, listed: Gazetteers) -> DataFrame:
    """docs with _base and _candidates. Each step is a column of its own, made once a row."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = docs.withColumns({f"_cut_{k}": _cut(F.col("_text"), k) for k in KINDS})
    docs = docs.withColumns({f"_{k}": _matches(F.col(f"_cut_{k}"), _ends(F.col(f"_cut_{k}"))) for k in KINDS})
    base = F.array_sort(F.concat(*[_base_spans(kind, rank) for rank, kind in enumerate(BASE)]))
    extra = [_candidates(kind, rank, listed) for rank, kind in enumerate(EXTRA, len(BASE))]
    docs = docs.withColumns({"_base": base, "_proposed": F.concat(*extra)})
    events, apart = _apart(F.col("_proposed"), F.col("_base"))
    both = (F.size("_base") > 0) & (F.size("_proposed") > 0)
    docs = docs.withColumn("_events", F.when(both, events))
    reach = _running(F.transform("_events", lambda e: e["end"]), lambda v, w: F.greatest(v, w))
    return docs.withColumn("_candidates", F.when(both, apart(F.col("_events"), reach)).otherwise(F.col("_proposed")))


@dataclass
class SpanClassifier:
    """A logistic model over _features; reliability: P(vote | class) by labeler, for reading."""

    bias: float
    weights: list[float]
    prior: dict[str, float]
    reliability: dict[str, dict[int, dict[int, float]]]

    def accepts(self, c: Column) -> Column:
        features = [c["votes"][j].cast("double") for j in range(len(LABELERS))] + [(c["kind"] == k).cast("double") for k in EXTRA] + [(c["length"] == n).cast("double") for n in range(4)] + [c["varied"].cast("double")]
        z = F.lit(self.bias)
        for w, f in zip(self.weights, features):
            z = z + F.lit(w) * f
        return z >= 0


def _features(r) -> list[float]:
    return [float(v) for v in r["votes"]] + [float(r["kind"] == k) for k in EXTRA] + [float(r["length"] == n) for n in range(4)] + [float(r["varied"])]


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 60, steps: int = 400, gazetteers: Gazetteers = Gazetteers()) -> SpanClassifier:
    """Learns from the candidates of all docs, each row's for itself: a text that repeats counts
    as often as it does, and a long one by all its candidates. Only counts of vote patterns (at
    most MAX_PATTERNS rows) reach the driver. Without candidates (no rows, null and empty
    texts), the classifier is the prior's: a candidate needs more votes for than against it."""
    c = _with_spans(docs.select(text_col), text_col, gazetteers).select(F.explode_outer("_candidates").alias("c")).where("c is not null")  # explode would push a filter below, with all that makes it
    rows = c.groupBy(*[F.col(f"c.{x}").alias(x) for x in ("kind", "votes", "length", "varied")]).count().collect()
    return fit_patterns(rows, rounds, steps)


def fit_patterns(rows: list, rounds: int = 60, steps: int = 400) -> SpanClassifier:
    """rows: kind, votes, length, varied, count."""
    rows = sorted(rows, key=lambda r: (r["kind"], list(r["votes"]), r["length"], r["varied"]))
    smooth = 1.0
    likely = [_sigmoid(2.0 * sum(r["votes"]) - 0.5) for r in rows]
    prior, rel = {k: 0.5 for k in EXTRA}, {}
    for _ in range(rounds):
        # Maximisation. Pseudo-counts say that a labeler votes with the truth more often than not.
        for k in EXTRA:
            n = sum(r["count"] for r in rows if r["kind"] == k)
            prior[k] = (smooth + sum(r["count"] * p for r, p in zip(rows, likely) if r["kind"] == k)) / (2 * smooth + n)
        rel = {}
        for j, name in enumerate(LABELERS):
            rel[name] = {}
            for truth in (0, 1):
                seen = {v: smooth * (2.0 if v == 2 * truth - 1 else 1.0) for v in (-1, 0, 1)}
                for r, p in zip(rows, likely):
                    seen[r["votes"][j]] += r["count"] * (p if truth else 1 - p)
                total = sum(seen.values())
                rel[name][truth] = {v: x / total for v, x in seen.items()}
        # Expectation.
        likely = []
        for r in rows:
            z = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            for j, name in enumerate(LABELERS):
                z += math.log(rel[name][1][r["votes"][j]] / rel[name][0][r["votes"][j]])
            likely.append(_sigmoid(z))
    total = sum(r["count"] for r in rows)
    bias, weights = -0.5, [1.0] * len(LABELERS) + [0.0] * (len(EXTRA) + 5)
    for _ in range(steps if total else 0):
        gb, gw = 0.0, [1e-3 * w for w in weights]
        for r, p in zip(rows, likely):
            f = _features(r)
            e = r["count"] / total * (_sigmoid(bias + sum(w * x for w, x in zip(weights, f))) - p)
            gb += e
            for i, x in enumerate(f):
                gw[i] += e * x
        bias -= gb
        weights = [w - g for w, g in zip(weights, gw)]
    return SpanClassifier(bias, weights, prior, rel)


def _as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _classified(docs: DataFrame, text_col: str, classifier: SpanClassifier, gazetteers: Gazetteers) -> DataFrame:
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = _with_spans(docs, text_col, gazetteers)
    rows = rows.withColumn("_added", F.transform(F.filter("_candidates", classifier.accepts), plain))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", "_added")))


def detect(docs: DataFrame, classifier: SpanClassifier | None = None, id_col: str = "doc_id", text_col: str = "text", gazetteers: Gazetteers = Gazetteers()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added), a row for each row.

    A null text is an empty one: no spans, the hash of an empty string, spans ''. Spans are in
    code points, end exclusive. Added spans never overlap base ones. Ids may be null or
    repeated, and repeated rows have a row each; other columns play no part. A text's matches
    take time in proportion to their number, but for the logarithm of it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _classified(docs, "text", classifier or fit(docs, gazetteers=gazetteers), gazetteers)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [count(kind) for kind in BASE]
    return rows.select("doc_id", *n, F.sha2(_as_text(F.col("_base")), 256).alias("base_sha256"), _as_text(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"), F.size("_added").cast("long").alias("n_added"))


def redact(docs: DataFrame, classifier: SpanClassifier | None = None, text_col: str = "text", gazetteers: Gazetteers = Gazetteers()) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, as in [EMAIL].

    Overlapping spans become one, named by the first. Null texts stay null, empty ones empty,
    repeated rows are rows of their own, and all other columns are as they were, whatever
    their names."""
    names = docs.columns
    docs, (text_col,) = renamed(docs, text_col)
    keep = docs.columns
    rows = _classified(docs, text_col, classifier or fit(docs, text_col, gazetteers=gazetteers), gazetteers)
    # Four bytes a code point, so that a piece of the text is found by its place alone.
    wide = F.when(F.size("_spans") > 0, F.encode("_text", "UTF-32"))
    rows = rows.withColumns({"_wide": wide, "_reach": _running(F.transform("_spans", lambda s: s["end"]), lambda v, w: F.greatest(v, w))})
    # A span begins a new one where it starts at or after all earlier ends.
    zipped = F.arrays_zip(F.col("_spans").alias("s"), F.concat(F.array(F.lit(0)), F.col("_reach")).alias("before"))
    rows = rows.withColumn("_firsts", F.filter(zipped, lambda x: x["before"] <= x["s"]["start"]))
    mark = F.unhex(F.lit("0000FEFF"))  # a byte order mark, which decoding takes away
    piece = lambda w, a, n: F.decode(F.concat(mark, F.substr(w, a * 4 + 1, n * 4)), "UTF-32")
    part = lambda w: lambda x: F.concat(piece(w, x["before"], x["s"]["start"] - x["before"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]"))
    # A variable of a function holds the bytes; read as a column they would be copied for every part.
    parts = F.get(F.transform(F.array("_wide"), lambda w: F.transform("_firsts", part(w))), F.lit(0))
    end = F.element_at("_reach", -1)
    tail = piece(F.col("_wide"), end, F.length("_text") - end)
    new = F.when(F.col(text_col).isNull() | (F.size("_spans") == 0), F.col(text_col)).otherwise(F.concat(F.array_join(parts, ""), tail))
    return rows.withColumn(text_col, new).select(*keep).toDF(*names)
