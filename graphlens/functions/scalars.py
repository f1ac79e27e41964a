"""Column functions of the scoring, lookup and folding operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of HTTP methods, severities' scores, price for 1,000 tokens.
METHOD_WEIGHT = {"DELETE": 3, "PUT": 2, "PATCH": 2, "POST": 2, "GET": 0, "HEAD": 0, "OPTIONS": 0}
SEVERITY_SCORE = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
TIERS = ((4, "cheap", 0.0002, 0.0008), (7, "mid", 0.003, 0.015), (10, "strong", 0.015, 0.075))
BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)


def lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def uid(*parts) -> Column:
    return F.concat_ws(":", *parts)


def parse_line(location: Column) -> Column:
    """The number after the last colon, else null."""
    return F.regexp_extract(location, ":(-?[0-9]+)$", 1).try_cast("int")


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def bayes(prior: Column, given: Column, otherwise: Column) -> Column:
    """P(H|E), the prior if the evidence is impossible, within [0, 1]."""
    total = prior * given + (1 - prior) * otherwise
    return F.when(total == 0, prior).otherwise(clamp(prior * given / total, 0.0, 1.0))


# Weights of parameters by kind, words of routes, in the order they are tried.
PARAM_WEIGHT = {"file": 4, "body": 2, "form": 1, "query": 1, "path": 0, "header": 0, "cookie": 0}
ADMIN_WORDS = (
    "admin", "manage", "dashboard", "config", "setting", "actuator", "jmx", "console", "swagger", "api-doc", "graphql", "graphiql", "debug", "trace", "profile", "health", "info",
    "metrics", "env", "log", "backup", "restore", "import", "export", "register", "signup", "login", "signin", "auth", "oauth", "token", "reset", "password", "verify", "user",
    "account", "profile", "role", "permission",
)
FILE_WORDS = ("upload", "download", "file", "image", "photo", "avatar", "attachment", "media", "static", "backup", "export", "import", "report")
CATEGORY_WORDS = (
    ("file_upload", ("upload", "file", "image", "avatar", "attachment")),
    ("admin_exposed", ("admin", "manage", "dashboard", "config", "setting", "actuator", "jmx", "console", "swagger", "api-doc")),
    ("config_leak", ("debug", "trace", "health", "info", "metrics", "env", "graphql", "graphiql")),
)
LOGIN_WORDS = ("login", "signin", "register", "signup", "token", "reset", "password", "oauth", "verify")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def params_score(kinds: Column) -> Column:
    """Weights of an array of parameter kinds, four at most."""
    return F.least(F.lit(4), F.aggregate(kinds, F.lit(0), lambda total, k: total + lookup(k, PARAM_WEIGHT, 0)))


def endpoint_score(method: Column, params: Column, auth: Column, route: Column) -> Column:
    """Risk from 1 to 10: base, method, parameters (their score, 4 at most), authentication and route."""
    mutating = ~method.isin("GET", "HEAD", "OPTIONS")
    score = 1 + lookup(method, METHOD_WEIGHT, 1) + F.least(F.lit(4), params)
    score = score + F.when(auth, -1).when(mutating, 3).otherwise(1)
    return clamp(score + F.when(holds(F.lower(route), ADMIN_WORDS), 2).otherwise(0) + F.when(holds(F.lower(route), FILE_WORDS), 3).otherwise(0), 1, 10).cast("int")


def category(method: Column, auth: Column, route: Column, has_file: Column | None = None) -> Column:
    """The first class that fits: files, administration, leaks, logins and changes without a guard, changes, reads."""
    path, out = F.lower(route), None
    for name, words in CATEGORY_WORDS:
        fits = holds(path, words) if out is not None or has_file is None else has_file | holds(path, words)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    changes = method.isin("POST", "PUT", "DELETE", "PATCH")
    return out.when(~auth & (holds(path, LOGIN_WORDS) | changes), "auth_bypass").when(changes, "data_mutation").when(~auth, "public_read").otherwise("unknown")


def cvss_label(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def complexity(length: Column, files: Column, is_async: Column, reflective: Column, depth: Column) -> Column:
    """1 to 10 from path length, files crossed, async, reflection and nesting."""
    part = 1 + F.least(F.lit(3), F.floor(length / 3)) + F.least(F.lit(3), files) + F.when(is_async, 2).otherwise(0) + F.when(reflective, 2).otherwise(0) + F.least(F.lit(2), F.floor(depth / 2))
    return F.least(F.lit(10), part).cast("int")


def tier(score: Column) -> Column:
    return F.when(score <= 4, "cheap").when(score <= 7, "mid").otherwise("strong")


def call_cost(score_tier: Column, tokens_in: Column) -> Column:
    out = None
    for _, name, into, back in TIERS:
        cost = tokens_in / 1000 * into + F.greatest(F.lit(100.0), F.floor(tokens_in / 5)) / 1000 * back
        out = F.when(score_tier == name, cost) if out is None else out.when(score_tier == name, cost)
    return F.round(out, 6)


def affordable(score_tier: Column, tokens_in: Column, budget: Column) -> Column:
    """The tier, stepped down until its cost fits the budget, else null."""
    fits = lambda name: call_cost(F.lit(name), tokens_in) <= budget
    strong, mid = score_tier == "strong", score_tier.isin("strong", "mid")
    return F.when(strong & fits("strong"), "strong").when(mid & fits("mid"), "mid").when(fits("cheap"), "cheap")


def version_below(actual: Column, minimum: Column) -> Column:
    """Dotted numbers compared with zeros for what is missing; if one is unreadable it is below."""
    read = lambda v: F.transform(F.split(v, "[.]"), lambda x: x.try_cast("int"))
    broken = F.coalesce(F.exists(F.concat(read(actual), read(minimum)), lambda x: x.isNull()), F.lit(True))
    n = F.greatest(F.size(read(actual)), F.size(read(minimum)))
    full = lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(read(v), i), F.lit(0)))
    return F.when(broken, True).otherwise(full(actual) < full(minimum))


def chao(only: Column, both: Column) -> Column:
    """Completeness of two overlapping searches from what one or both found."""
    return (
        F.when((only == 0) & (both == 0), 1.0).when(both == 0, 0.0).when(only == 0, 1.0)
        .otherwise(clamp(1 - only.cast("double") * only / (2 * both), 0.0, 1.0))
    )


def cwe_score(a: Column, b: Column, families: tuple[tuple[str, ...], ...]) -> Column:
    """1 equal, 0.7 one family, 0.3 both weaknesses, else 0."""
    kin = F.lit(False)
    for family in families:
        kin = kin | (a.isin(*family) & b.isin(*family))
    return F.when(a == b, 1.0).when(kin, 0.7).when(a.startswith("CWE-") & b.startswith("CWE-"), 0.3).otherwise(0.0)


def severity_distance(a: Column, b: Column) -> Column:
    left, right = lookup(a, SEVERITY_RANK, -1), lookup(b, SEVERITY_RANK, -1)
    return F.when((left < 0) | (right < 0), 999).otherwise(F.abs(left - right)).cast("int")


def merge_routes(prefix: Column, route: Column) -> Column:
    """Two parts of a route with one slash between them."""
    a, b = F.regexp_replace(prefix, "/+$", ""), F.regexp_replace(route, "^/+", "")
    joined = F.when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def word_in(text: Column, word: Column) -> Column:
    """Whether the word stands in the text as a whole identifier."""
    return F.rlike(text, F.concat(F.lit(r"(^|[^A-Za-z0-9_$])\Q"), word, F.lit(r"\E([^A-Za-z0-9_$]|$)")))
