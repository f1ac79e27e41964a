"""Personal data in text by weak supervision, in DataFrame functions only.

Base spans come from four validated patterns. Wider candidate patterns are voted on
by four labelers (strict pattern, gazetteer, context, shape). Expectation-maximisation
over the table of vote patterns estimates how reliable each labeler is for each kind;
its posteriors train a naive Bayes span classifier on shape features, which decides
about the candidates beyond the base spans.

Null or empty text has no spans. Repeated rows are judged alike, each by itself; input
columns beyond the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, let

KINDS = ("email", "ip", "card", "phone", "secret")

# Fixed patterns of the base spans. Possessive repeats and the look-behinds change no
# match; they keep long runs linear and off the regex engine's stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Wider patterns of candidates.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{12,64}(?![A-Za-z0-9+/_-])"

# Fixed word lists of the labelers.
TOP_LEVEL = "com|org|net|edu|gov|int|info|biz|io|dev|app|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|se|no|dk|pl|pt|jp|cn|in|br|au|nz"
CUES = {
    "email": "mail|contact|write|schreib|courriel|correo",
    "ip": "ip|address|host|server|adresse|direcci",
    "card": "card|visa|master|amex|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|llam",
    "secret": "password|passwd|secret|token|api.?key|credential",
}
AGAINST = "version|isbn|issn|invoice|order|serial|release|page|figure|sha|commit|checksum"
CONTEXT = 32


def _running(lengths: Column) -> Column:
    """Running sums of an array; blocks of 64 keep long arrays from a square of steps."""
    zero = F.lit(0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(64)), lambda c: total(F.slice(lengths, c + 1, F.lit(64))))
    before = let(blocks, lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))))
    block = lambda i: F.floor(i / 64).cast("int")
    return let(before, lambda b: F.transform(lengths, lambda _, i: F.get(b, block(i)) + total(F.slice(lengths, block(i) * 64 + 1, i % 64 + 1))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches, in code points.

    What lies between matches (``split``) and the matches themselves alternate, so
    running sums of their lengths are the positions.
    """
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, empty).otherwise(
            let(
                F.split(text, pattern, -1),
                lambda rest: let(
                    F.transform(found, lambda m, i: F.length(m) + F.length(F.get(rest, i))),
                    lambda steps: F.transform(
                        F.arrays_zip(_running(steps).alias("e"), found.alias("v")),
                        lambda x: F.struct((x["e"] - F.length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v")),
                    ),
                ),
            )
        ),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, F.length(number) - i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match of the base pattern must also fulfil."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).try_cast("int") <= 255))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _votes(kind: str, text: Column, x: Column) -> list[Column]:
    """Votes 1, 0 or -1 of the four labelers about a candidate."""
    value, before = x["v"], F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT), F.least(x["s"], F.lit(CONTEXT))))
    edges = F.concat(F.substring(text, x["s"], F.lit(1)), F.substring(text, x["e"] + 1, F.lit(1)))
    sure = lambda c: F.when(c, 1).otherwise(-1)
    strict = {"email": f"^(?:{EMAIL})$", "phone": r"^(?:\+|\(?[2-9])", "secret": "^[0-9a-f]{16,64}$"}
    pattern = sure(value.rlike(strict[kind])) if kind in strict else sure(valid(kind, value))
    gazetteer = {
        "email": sure(F.lower(value).rlike(rf"[.\]) ](?:{TOP_LEVEL})$")),
        "ip": sure(~value.rlike(r"^(?:0|127|255|22[4-9]|2[3-5][0-9])\.")),
        "card": sure(digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": sure(digits(value).rlike("^(?:1?[2-9]|[2-9])")),
        "secret": F.when(F.lower(value).rlike("example|changeme|xxxx|1234|password"), -1).otherwise(0),
    }[kind]
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    return [pattern, gazetteer, context, sure(~edges.rlike("[A-Za-z0-9]"))]


def _features(value: Column, votes: list[Column]) -> list[Column]:
    """Small integers: length band, share of digits, separators, labels' context and shape."""
    size, share = F.length(value), F.length(digits(value)) * 4 / F.length(value)
    band = F.when(size < 9, 0).when(size < 13, 1).when(size < 17, 2).when(size < 25, 3).otherwise(4)
    return [band, F.floor(share).cast("int"), F.when(value.rlike("[ ().-]"), 1).otherwise(0), votes[2], votes[3]]


def spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, candidates) for each row: base spans and voted candidates as arrays."""
    raw = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    text = F.col("text")
    at, digit = text.rlike(r"@|[\[(]at[\])]"), text.rlike("[0-9]")
    found = raw.withColumns(
        {
            "m_email": F.when(text.contains("@"), matches(text, EMAIL)).otherwise(none),
            "m_ip": F.when(digit, matches(text, IP)).otherwise(none),
            "m_card": F.when(digit, matches(text, CARD)).otherwise(none),
            "m_phone": F.when(text.contains("+"), matches(text, PHONE)).otherwise(none),
            "c_email": F.when(at, matches(text, LOOSE_EMAIL)).otherwise(none),
            "c_phone": F.when(digit, matches(text, LOOSE_PHONE)).otherwise(none),
            "c_secret": F.when(digit, matches(text, SECRET)).otherwise(none),
        }
    )

    def checked(k: int, kind: str) -> Column:
        fine = F.filter(F.col(f"m_{kind}"), lambda x: valid(kind, x["v"]))
        return F.transform(fine, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    base = [checked(k, kind) for k, kind in enumerate(KINDS[:4])]

    def voted(column: Column, kind: str) -> Column:
        def row(x: Column) -> Column:
            return let(
                F.array(*_votes(kind, text, x)),
                lambda v: F.struct(
                    x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), v.alias("votes"),
                    F.array(*_features(x["v"], [F.get(v, F.lit(i)) for i in range(4)])).alias("features"),
                ),
            )

        return F.transform(column, row)

    wide = F.filter(F.col("m_card"), lambda x: F.length(digits(x["v"])).between(12, 19))
    candidates = [
        voted(F.col("c_email"), "email"), voted(F.col("m_ip"), "ip"), voted(wide, "card"),
        voted(F.concat("m_phone", "c_phone"), "phone"), voted(F.col("c_secret"), "secret"),
    ]
    return found.select("id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*candidates).alias("candidates"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count) rows.

    Returns P(true | kind, votes) and the labelers' P(vote | kind, labeler, truth).
    The table has at most 81 vote patterns for each kind, however large the corpus is.
    """
    posterior = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in counts}
    chance: dict = {}
    for _ in range(rounds):
        mass, seen = defaultdict(float), defaultdict(float)
        for k, votes, n in counts:
            for truth, p in ((1, posterior[k, votes]), (0, 1 - posterior[k, votes])):
                mass[k, truth] += n * p
                for i, vote in enumerate(votes):
                    seen[k, i, truth, vote] += n * p
        chance = {(k, i, t, v): (seen[k, i, t, v] + 1) / (mass[k, t] + 3) for k in range(len(KINDS)) for i in range(4) for t in (0, 1) for v in (-1, 0, 1)}
        for k, votes, _ in counts:
            odds = math.log((mass[k, 1] + 1) / (mass[k, 0] + 1))
            odds += sum(math.log(chance[k, i, 1, v] / chance[k, i, 0, v]) for i, v in enumerate(votes))
            posterior[k, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, chance


def classifier(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> dict[str, float]:
    """Weights of the span classifier, by "kind", and by "kind:feature:value"."""
    merged: dict = defaultdict(int)
    for k, votes, _, n in counts:
        merged[k, votes] += n
    posterior, _ = reliabilities([(k, v, n) for (k, v), n in merged.items()])
    mass, seen, weights = defaultdict(float), defaultdict(float), {}
    for k, votes, features, n in counts:
        for truth, p in ((1, posterior[k, votes]), (0, 1 - posterior[k, votes])):
            mass[k, truth] += n * p
            for i, value in enumerate(features):
                seen[k, i, value, truth] += n * p
    for k in range(len(KINDS)):
        weights[str(k)] = math.log((mass[k, 1] + 1) / (mass[k, 0] + 1))
    for k, i, value, _ in list(seen):
        part = [(seen[k, i, value, t] + 1) / (mass[k, t] + 5) for t in (1, 0)]
        weights[f"{k}:{i}:{value}"] = math.log(part[0] / part[1])
    return weights


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, extra): arrays of struct<s, k, e>, k an index into ``KINDS``.

    The votes and the features of all candidates of all documents train the model; only
    the table of their counts (at most some thousands of rows) reaches the driver.
    """
    store = Scratch(documents.sparkSession, "pii")
    rows = store.table(spans(documents, id_column, text_column), "spans")
    counts = rows.select(F.explode("candidates").alias("c")).groupBy("c.k", "c.votes", "c.features").count().collect()
    weights = classifier([(r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in counts])
    known = F.create_map(*[F.lit(x) for item in (weights | {"": 0.0}).items() for x in item])

    def score(c: Column) -> Column:
        parts = F.transform(c["features"], lambda f, i: F.coalesce(F.try_element_at(known, F.concat_ws(":", c["k"], i, f)), F.lit(0.0)))
        return F.aggregate(parts, F.try_element_at(known, c["k"].cast("string")), lambda a, x: a + x)

    clear = lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    kept = F.filter(F.col("candidates"), lambda c: (score(c) > 0) & clear(c))
    plain = F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return rows.select("id", "base", F.array_distinct(plain).alias("extra"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns: counts and hash of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return find(documents).select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
    )
