"""Personal data and secrets by weak supervision; DataFrame operations only.

Candidates are the spans of the base patterns and of looser ones: an e-mail address spelt "name (at) host (dot) tld", a phone
number without +, a card number that fails Luhn's test, an IPv6 address, a US social security number, an IBAN, and long runs
of letters with digits (keys and tokens). They fall into families, and in each five labelers vote on a span (1, -1, or 0: abstain).
No labeler repeats the pattern that found the span: they look at its parts (checksums, ranges, grouping), at a gazetteer (top-level
domains, dialling codes, issuers, countries, names of keys), at words nearby, at its borders, and at what other families find in the text.
Per family, expectation-maximisation over all documents' votes estimates the labelers' reliabilities and each vote pattern's
probability; these soft labels train the final span classifier, naive Bayes over votes and length. Which pattern found a span is no input.
Spans of the base patterns always stay; others are added if the classifier gives ADD or more and they touch no base span. What
the driver gets is one count per vote pattern: 7 families * 3^5 votes * 6 lengths at most.

Time is n log n in the text's length, whatever it holds: patterns are anchored so that each run of characters is tried once, places
follow from running sums, and overlaps from running extremes, in log(n) passes over an array. Offsets count code points, ends are exclusive.
Null and empty texts have no spans; an empty table gives no rows. Rows that repeat an id, and null ids, are rows of their own.
Spans that begin at one place are ordered by kind. Columns are found by position, so names that clash do no harm. Building
the result runs the jobs up to the classifier.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import materialize, packed

#: In the order of the result.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_words", "ipv6", "card_unchecked", "phone_local", "ssn", "iban", "secret")
FAMILY = {
    "email": "email", "email_words": "email", "ip": "ip", "ipv6": "ip", "card": "card", "card_unchecked": "card",
    "phone": "phone", "phone_local": "phone", "ssn": "ssn", "iban": "iban", "secret": "secret",
}
ADD = 0.9
ROUNDS = 50
#: Characters on either side of a span that labelers see.
NEAR = 48
#: Passes of a running sum: enough for 8^10 spans, more than a string has room for.
PASSES = 10

# Possessive quantifiers and look-behinds say what the plain patterns say, without their backtracking; \G lets a match begin where the last ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole run of digits with single separators, if it has 14 to 19 digits; the plain pattern takes whole runs too.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_EMAIL_WORDS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[][Aa][Tt][)\]] ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?(?:[(\[][Dd][Oo][Tt][)\]]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+"
)
_NUMBERS = (
    r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"
)
_IPV6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|(?::?[0-9A-Fa-f]{1,4}))(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])"
_SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"

# Gazetteers.
TLDS = "com org net edu gov io info biz co uk de fr es it nl eu ch at us ca au jp cn in br ru".split()
IBAN_LANDS = (
    "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
)
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30|36|38)"
DIALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_NAMES = r"\b(?:token|secret|passwords?|passwd|pwd|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|bearer|credentials?|auth)\b"
DIGEST_NAMES = r"\b(?:sha-?[0-9]*|md5|hash|commit|checksum|digest|etag|revision|uuid|guid|file|url|https?)\b"
KEY_PREFIXES = r"^(?:sk[-_]|pk[-_]|gh[pousr]_|AKIA|ASIA|xox[abprs]-|AIza|eyJ|glpat-)"
# Words nearby, for and against.
FOR = {
    "email": r"\b(?:e-?mails?|mail|mailto|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"\b(?:ip|ipv4|ipv6|address|host|server|client|adresse|direcci)\w*\b",
    "card": r"\b(?:cards?|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t.l.phone|tel.fono)\b",
    "ssn": r"\b(?:ssn|social security|taxpayer)\b",
    "iban": r"\b(?:iban|account|konto|compte|cuenta)\b",
}
AGAINST = r"\b(?:version|section|isbn|issn|doi|order|invoice|page|figure|table|id|sku|example)\b"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(x: Column, op: Callable[..., Column]) -> Column:
    """The running op (associative, null-skipping) of an array: each pass takes in what lies eight times as far back, so none copies a prefix."""

    def far(d: int) -> Callable[[Column], Column]:
        both = lambda a: F.transform(a, lambda v, i: op(v, *(F.get(a, i - k * d) for k in range(1, 8))))
        return lambda a: F.when(F.size(a) > d, both(a)).otherwise(a)

    for k in range(PASSES):
        x = let(x, far(8**k))
    return x


def _sum(*columns: Column) -> Column:
    return reduce(add, (F.coalesce(c, F.lit(0)) for c in columns))


def _located(split: DataFrame, names: list[str]) -> DataFrame:
    """From hits_<name> and gaps_<name>: id and <name>, array<struct<start, end, hit, before, after>>.

    Places follow from the lengths of matches and of the text between them: one running sum over the arrays of all names in a row.
    """
    length = lambda k: F.transform(f"hits_{k}", lambda h, i: F.length(F.get(f"gaps_{k}", i)) + F.length(h))
    first = {k: _sum(F.lit(0), *(F.size(f"hits_{j}") for j in names[:n])) for n, k in enumerate(names)}
    split = split.select("*", F.concat(*map(length, names)).alias("lengths"), *(c.alias(f"first_{k}") for k, c in first.items()))
    split = split.select("*", running(F.col("lengths"), _sum).alias("ends"))

    def placed(k: str) -> Column:
        def one(h: Column, i: Column) -> Column:
            end = F.get("ends", F.col(f"first_{k}") + i) - F.coalesce(F.get("ends", F.col(f"first_{k}") - 1), F.lit(0))
            before, after = F.substring(F.get(f"gaps_{k}", i), -NEAR, NEAR), F.substring(F.get(f"gaps_{k}", i + 1), 1, NEAR)
            parts = {"start": end - F.length(h), "end": end, "hit": h, "before": before, "after": after}
            return F.struct(*(c.alias(n) for n, c in parts.items()))

        return F.transform(f"hits_{k}", one).alias(k)

    return split.select("id", *map(placed, names))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Luhn's test of a string of digits."""
    n = F.length(x)
    digit = lambda i: F.substring(x, i, F.lit(1)).cast("int")
    double = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, double(digit(i))).otherwise(digit(i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(x: Column) -> Column:
    """An IBAN's checksum: its first four characters go last, letters count from 10, and the number leaves 1."""
    x = F.upper(F.translate(x, " ", ""))
    turned = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
    step = lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _octets(x: Column) -> Column:
    """Whether all parts of a dotted quad are 255 at most, whatever zeros they begin with."""
    small = "^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    return F.forall(F.split(x, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", "").rlike(small))


def _candidates(c: dict[str, Column]) -> dict[str, Column]:
    """Arrays of candidate spans by kind, from the arrays of located matches."""
    of_shape = lambda s: lambda x: x["hit"].rlike(s)
    luhn = lambda x: _luhn(_digits(x["hit"]))
    return {
        "email": c["email"],
        "ip": F.filter(c["ip"], lambda x: _octets(x["hit"])),
        "card": F.filter(c["card"], luhn),
        "phone": F.filter(c["phone"], lambda x: F.length(_digits(x["hit"])).between(10, 15)),
        "email_words": c["email_words"],
        "ipv6": F.filter(c["ipv6"], of_shape("^(?:[^:]+:){7}[^:]+$|::")),
        "card_unchecked": F.filter(c["card"], lambda x: ~luhn(x)),
        "phone_local": F.filter(c["numbers"], of_shape(r"^(?:\(|[0-9]{3}[ .-][0-9]{3}[ .-])")),
        "ssn": F.filter(c["numbers"], of_shape(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "iban": F.filter(c["numbers"], of_shape("^[A-Z]")),
        "secret": F.filter(c["secret"], lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")),
    }


def _vote(good: Column, bad: Column | None = None) -> Column:
    """1, -1, or 0 where neither is said; without bad, what is not good is bad."""
    return F.when(good, F.lit(1)).when(~good if bad is None else bad, F.lit(-1)).otherwise(F.lit(0))


def _votes(family: str, x: Column, company: Column) -> list[Column]:
    """Five labelers' votes on a span: parts, gazetteer, words nearby, borders, and other families in the text."""
    hit, digits, never = x["hit"], _digits(x["hit"]), F.lit(False)
    before, after = x["before"], x["after"]
    if family == "email":
        host = F.lower(F.regexp_replace(hit, r"(?i)^.*?(?:@|[(\[]at[)\]])|[(\[]dot[)\]]| ", "."))
        parts, known = _vote(host.rlike(r"\.[a-z]{2,}$") & ~host.rlike(r"-\.|\.-")), _vote(F.element_at(F.split(host, r"\."), -1).isin(TLDS), never)
    elif family == "ip":
        parts = _vote(~hit.rlike(r"(?:^|[.:])0[0-9]"))
        known = _vote(~hit.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\.|^(?:::1$|fe80|fc|fd)"), hit.rlike(r"^(?:0|255)\.|^(?:[0-9]{1,2}\.){3}[0-9]$"))
    elif family == "card":
        parts, known = _vote(_luhn(digits)), _vote(digits.rlike(ISSUERS) & (F.length(digits) <= 16))
    elif family == "phone":
        grouped = hit.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$")
        parts = _vote(grouped & F.length(digits).between(10, 13))
        known = F.when(hit.startswith("+"), _vote(hit.rlike(DIALLING))).otherwise(_vote(digits.rlike("^[2-9][0-9]{2}[2-9]")))
    elif family == "ssn":
        parts, known = _vote(~hit.rlike("^(?:000|666|9)|-00-|-0000$")), _vote(never, digits.isin("123456789", "078051120", "111111111"))
    elif family == "iban":
        parts, known = _vote(_mod97(hit)), _vote(F.substring(hit, 1, 2).isin(IBAN_LANDS))
    else:
        kinds = F.size(F.array_distinct(F.split(hit, "")))
        shaped = hit.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | (hit.rlike("[a-z]") & hit.rlike("[A-Z]"))
        parts = _vote(shaped & (kinds >= 10), ~shaped | (kinds < 8))
        known = _vote(hit.rlike(KEY_PREFIXES) | F.lower(before).rlike(KEY_NAMES + r"\W*$"), hit.rlike("/[a-z]+/|---|==="))
    low = F.lower(before)
    if family == "secret":
        context = F.when(low.rlike(KEY_NAMES), 1).when(low.rlike(DIGEST_NAMES), -1).otherwise(0)
        borders = _vote(before.rlike("[=:] ?[\"']?$"), before.rlike(r"[A-Za-z0-9._/]$") | after.rlike(r"^[./][A-Za-z0-9]"))
    else:
        context = F.when(low.rlike(FOR[family]), 1).when(low.rlike(AGAINST), -1).otherwise(0)
        borders = _vote(~before.rlike(r"[A-Za-z0-9_]$|[0-9][.,:/-]$") & ~after.rlike(r"^(?:[A-Za-z0-9_]|[.,:/-][0-9])"))
    return [parts, known, context, borders, _vote(company, never)]


def _pattern(family: str, x: Column, company: Column) -> Column:
    """family, votes, and a class of length, as one string."""
    length = F.least(F.lit(5), (F.length(x["hit"]) / 6).cast("int"))
    return F.concat_ws("|", F.lit(family), *(v.cast("string") for v in _votes(family, x, company)), length.cast("string"))


def spans_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, loose), written: arrays of (start, rank, end, kind, pattern); the texts are read once."""
    rows = packed(df, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    patterns = {
        "email": (_EMAIL, text.contains("@")),
        "ip": (_IP, digit),
        "card": (_CARD, digit),
        "phone": (_PHONE, text.contains("+")),
        "email_words": (_EMAIL_WORDS, F.lower(text).rlike(r"[(\[]at[)\]]")),
        "numbers": (_NUMBERS, digit),
        "ipv6": (_IPV6, digit & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]")),
        "secret": (_SECRET, digit & text.rlike("[A-Za-z0-9_+/=-]{20}")),
    }
    none = F.array().cast("array<string>")
    hits = (F.when(when, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"hits_{k}") for k, (p, when) in patterns.items())
    found = rows.select("id", "text", *hits)
    gaps = (F.when(F.size(f"hits_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"gaps_{k}") for k, (p, _) in patterns.items())
    split = found.select("*", *gaps)
    kinds = _located(split, list(patterns)).select("id", *(c.alias(k) for k, c in _candidates({k: F.col(k) for k in patterns}).items()))
    families = sorted(set(FAMILY.values()))
    seen = {f: sum(F.size(k) for k in FAMILY if FAMILY[k] == f) > 0 for f in families}
    kinds = kinds.select("*", *(seen[f].alias(f"has_{f}") for f in families))

    def short(k: str) -> Column:
        company = F.greatest(*(F.col(f"has_{f}") for f in families if f != FAMILY[k]))
        rank = F.lit((*BASE, *LOOSE).index(k))
        fields = lambda x: {"start": x["start"], "rank": rank, "end": x["end"], "kind": F.lit(k), "pattern": _pattern(FAMILY[k], x, company)}
        return F.transform(k, lambda x: F.struct(*(c.alias(n) for n, c in fields(x).items())))

    lists = {"base": F.concat(*map(short, BASE)), "loose": F.concat(*map(short, LOOSE))}
    return materialize(kinds.select("id", *(F.array_sort(c).alias(n) for n, c in lists.items())), "spans")


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation (Dawid and Skene, two classes): the probability of each vote pattern to be personal data.

    It starts from the votes' majority, in which the first labeler (parts: checksums and the like) counts double.
    """
    p = {v: {1: 0.9, 0: 0.5, -1: 0.1}[(s > 0) - (s < 0)] for v in counts for s in [v[0] + sum(v)]}  # parts count double
    total = sum(counts.values())
    for _ in range(rounds):
        prior = (1 + sum(counts[v] * p[v] for v in counts)) / (2 + total)
        table = []
        for k in range(len(next(iter(counts)))):
            seen: dict[tuple[int, int], float] = defaultdict(lambda: 1.0)  # Laplace's one
            # Votes are likelier right than wrong before any evidence, so classes cannot swap.
            seen[1, 1] = seen[0, -1] = 3.0
            for v, n in counts.items():
                seen[1, v[k]] += n * p[v]
                seen[0, v[k]] += n * (1 - p[v])
            table.append({(y, x): seen[y, x] / sum(seen[y, z] for z in (-1, 0, 1)) for y in (0, 1) for x in (-1, 0, 1)})
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1, x] / t[0, x]) for t, x in zip(table, v, strict=True))
            p[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return p


def classifier(counts: dict[str, int]) -> dict[str, float]:
    """From the count of each pattern: its score, by naive Bayes trained on the soft labels of its family."""
    families: dict[str, list[tuple[str, list[str], int]]] = defaultdict(list)
    for pattern, n in counts.items():
        families[pattern.split("|")[0]].append((pattern, pattern.split("|"), n))
    out: dict[str, float] = {}
    for rows in families.values():
        votes: dict[tuple[int, ...], float] = defaultdict(float)
        for _, x, n in rows:
            votes[tuple(map(int, x[1:-1]))] += n
        soft = reliabilities(votes)
        width = len(rows[0][1])
        values = [{x[k] for _, x, _ in rows} for k in range(width)]
        weight: dict[tuple[int, int, str], float] = defaultdict(lambda: 0.5)
        totals = [1.0, 1.0]
        for _, x, n in rows:
            p = soft[tuple(map(int, x[1:-1]))]
            for y, q in ((1, p), (0, 1 - p)):
                totals[y] += n * q
                for k in range(width):
                    weight[y, k, x[k]] += n * q
        for pattern, x, _ in rows:
            odds = math.log(totals[1] / totals[0])
            for k in range(width):
                share = [weight[y, k, x[k]] / (totals[y] - 1 + 0.5 * len(values[k])) for y in (0, 1)]
                odds += math.log(share[1] / share[0])
            out[pattern] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def _apart(table: DataFrame) -> DataFrame:
    """(id, base, spans): base and those chosen that overlap none of it; the furthest end before a span and the next start after it tell."""
    is_base = lambda x: x["rank"] < len(BASE)
    merged = F.when(F.size("chosen") == 0, F.array().cast(table.schema["base"].dataType)).otherwise(F.array_sort(F.concat("base", "chosen")))
    table = table.select("id", "base", merged.alias("merged"))
    ends = F.transform("merged", lambda x: F.when(is_base(x), x["end"]).otherwise(-1))
    table = table.select("*", running(ends, F.greatest).alias("ends"))
    starts = F.transform(F.reverse("merged"), lambda x: F.when(is_base(x), x["start"]).otherwise(2**31 - 1))
    table = table.select("*", F.reverse(running(starts, F.least)).alias("starts"))
    free = lambda e, s: F.filter("merged", lambda x, i: is_base(x) | ((F.get(e, i) <= x["start"]) & (F.get(s, i) >= x["end"])))
    apart = let(F.col("ends"), lambda e: let(F.col("starts"), lambda s: free(e, s)))
    return table.select("id", "base", F.when(F.size("merged") == 0, F.col("base")).otherwise(apart).alias("spans"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", add: float = ADD) -> DataFrame:
    """One row per row of df: id, base, spans; arrays of (start, rank, end, kind, pattern) by start, then kind."""
    table = spans_table(df, id_col, text_col)
    every = table.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy(F.col("x.pattern").alias("pattern")).count()
    scores = classifier({r["pattern"]: r["count"] for r in every.collect()})  # bounded: see above
    good = sorted(p for p, s in scores.items() if s >= add)
    chosen = F.filter("loose", lambda x: x["pattern"].isin(good) if good else F.lit(False))
    return _apart(table.select("id", "base", chosen.alias("chosen")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
