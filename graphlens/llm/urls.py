"""URL verdicts: fixed host and path rules first, boosted trees on lexical features
for the rest, in DataFrame functions only.

Null urls, and those without ``://``, have an empty host and path; no rule fits them and
the trees judge their features (all zero). Rows with equal urls get equal verdicts.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import ascii_lower, let

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Parts of the labelled urls, for statistics of the others.
FOLDS = 5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "path_length", "suffix")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty without ``://``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return F.when(there, ascii_lower(host)).otherwise(""), F.when(there, path).otherwise("")


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else null."""
    text, verdict = None, None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    letters = F.split(text, "")
    return F.when(n > 0, let(letters, lambda cs: F.aggregate(
        F.array_distinct(cs), F.lit(0.0),
        lambda acc, c: acc - let(F.size(F.filter(cs, lambda x: x == c)) / n, lambda q: q * F.log2(q)),
    ))).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Small integers, so that the trees are learned from a table of counts."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    level = lambda c, top: F.least(F.floor(c), F.lit(top)).cast("int")
    number = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "length": level(n / 8, 31),
        "depth": level(count(path, "/"), 15),
        "digit_ratio": level(F.when(n > 0, number * 32 / n).otherwise(0), 31),
        "entropy": level(_entropy(url) * 4, 31),
        "n_params": level(F.when(F.instr(url, "?") > 0, count(F.substring_index(url, "?", -1), "=")).otherwise(0), 15),
        "n_labels": level(F.when(host == "", 0).otherwise(count(host, ".") + 1), 15),
        "path_length": level(F.length(path) / 4, 31),
    }


def suffix_of(host: Column, path: Column) -> Column:
    """Top-level domain and file ending: the key of the suffix statistics. The rules look at
    more of the host and at the path's beginning, so urls that none fits have these keys too."""
    return F.concat_ws("/", F.substring_index(host, ".", -1), F.regexp_extract(path, r"\.([^./]*)$", 1))


def boost(rows: list[tuple[tuple[int, ...], int, int]], trees: int = 24, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    """Boosted regression trees for logistic loss on (features, label, count) rows.

    A tree is a leaf value or (feature, threshold, tree if below or equal, tree above).
    """
    total = defaultdict(lambda: [0, 0])
    for x, y, n in rows:
        total[x][y] += n
    data = sorted(total.items())
    zeros, ones = (sum(c[y] for _, c in data) for y in (0, 1))
    base = math.log((ones + 1) / (zeros + 1))
    score = [base] * len(data)

    def grow(members: list[int], grad: list[float], hess: list[float], left: int):
        g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
        best = (1e-6, None, None)
        for f in range(len(data[0][0]) if left else 0):
            sums = defaultdict(lambda: [0.0, 0.0])
            for i in members:
                s = sums[data[i][0][f]]
                s[0] += grad[i]
                s[1] += hess[i]
            a = b = 0.0
            for value in sorted(sums)[:-1]:
                a, b = a + sums[value][0], b + sums[value][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                best = max(best, (gain, f, value), key=lambda z: z[0])
        if best[1] is None:
            return rate * g / (h + 1)
        _, f, value = best
        low, high = ([i for i in members if (data[i][0][f] <= value) == side] for side in (True, False))
        return (f, value, grow(low, grad, hess, left - 1), grow(high, grad, hess, left - 1))

    forest = []
    for _ in range(trees if data else 0):
        chance = [1 / (1 + math.exp(-s)) for s in score]
        grad = [c[1] - (c[0] + c[1]) * p for (_, c), p in zip(data, chance, strict=True)]
        hess = [(c[0] + c[1]) * p * (1 - p) for (_, c), p in zip(data, chance, strict=True)]
        tree = grow(list(range(len(data))), grad, hess, depth)
        forest.append(tree)
        score = [s + evaluate(tree, x) for s, (x, _) in zip(score, data, strict=True)]
    return base, forest


def evaluate(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def expression(tree, names: tuple[str, ...] = FEATURES) -> Column:
    """A tree as a conditional expression."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(names[tree[0]]) <= tree[1], expression(tree[2], names)).otherwise(expression(tree[3], names))


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, sample: int = 20_000) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row.

    Urls that a rule fits are the labelled ones; all of them count in the statistics of the
    suffixes. The trees learn from ``sample`` of them at most (smallest hashes), each with the
    statistics of the other folds, so that no label speaks for itself.
    """
    raw = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    host, path = parts(F.col("url"))
    rows = raw.withColumn("host", host).withColumn("path", path)
    text, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict, "tail": suffix_of(F.col("host"), F.col("path"))})
    rows = rows.withColumns(features(F.col("url"), F.col("host"), F.col("path")))

    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    labelled = rows.where("rule is not null").withColumns({"y": (F.col("ruled") == "block").cast("int"), "fold": fold})
    each = lambda value: F.array(*[F.sum(F.when(F.col("fold") == k, value).otherwise(0)) for k in range(FOLDS)])
    stats = labelled.groupBy("tail").agg(F.count("*").alias("n"), F.sum("y").alias("s"), each(F.lit(1)).alias("ns"), each(F.col("y")).alias("ss"))
    share = lambda s, n: F.floor(31 * (s + 1) / (n + 2)).cast("int")
    others = share(F.col("s") - F.col("ss")[F.col("fold")], F.col("n") - F.col("ns")[F.col("fold")])
    chosen = labelled.orderBy(F.xxhash64("url"), "url").limit(sample).join(stats, "tail").withColumn("suffix", others)
    counts = chosen.groupBy(*FEATURES, "y").count().collect()
    base, forest = boost([(tuple(r[: len(FEATURES)]), r[-2], r[-1]) for r in counts])

    none = F.lit(0)
    rows = rows.join(stats.select("tail", "n", "s"), "tail", "left").withColumn("suffix", share(F.coalesce("s", none), F.coalesce("n", none)))
    score = F.lit(base)
    for tree in forest:
        score = score + expression(tree)
    return rows.withColumn("score", F.round(1 / (1 + F.exp(-score)), 6)).select(
        "id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
