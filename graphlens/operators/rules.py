"""Rule matching over lines and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMENT = r"^(//|/\*|\*|#|<!--)"

#: A small rule table in the engine's own wording: id, pattern, severity, languages, order.
LINE_RULES = (
    ("CRED-1", "password ?=", "high", "", 0), ("CRED-1", "token ?= ?\"", "high", "", 1), ("LIC-1", "licensed under", "low", "en,fr,de,es", 0),
    ("LIC-1", "released under", "low", "", 1), ("NET-1", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "medium", "", 0), ("NET-2", "@mail[0-9]", "medium", "", 0), ("BAD-1", "call(", "low", "", 0),
)
#: category, section, pattern, order
TEXT_RULES = (
    ("article", "source", "the ", 0), ("article", "source", "and the ", 1), ("verb", "source", "was ", 2), ("latin", "source", "de ", 3), ("latin", "sink", "la ", 4),
    ("german", "sink", "der ", 5), ("german", "sink", "und der", 6), ("spanish", "sink", "que ", 7), ("french", "sink", "le ", 8), ("stop", "exclude", "junk|spam", 9),
)


def is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def line_rules(spark: SparkSession, rules=LINE_RULES) -> DataFrame:
    """(rule_id, pattern, is_regex, severity, languages, ord); invalid patterns are substrings."""
    rows = [(i, p, is_regex(p), s, [x for x in langs.split(",") if x], o) for i, p, s, langs, o in rules]
    return spark.createDataFrame(rows, "rule_id string, pattern string, is_regex boolean, severity string, languages array<string>, ord int")


def text_rules(spark: SparkSession, rules=TEXT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "category string, section string, pattern string, ord int")


def is_comment(line: Column) -> Column:
    return F.trim(line).rlike(COMMENT)


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("test", "tests", "testing", "__tests__"))))


def scan_lines(lines: DataFrame, rules=LINE_RULES) -> DataFrame:
    """(file, line_no, rule_id, severity, pattern): one finding for each line and rule, by its
    first matching pattern. The rules are literals of one expression, so the scan stays in
    generated code and nothing is shuffled; a rule without languages holds for all."""
    by_rule: dict[str, list] = {}
    for rule in sorted(rules, key=lambda r: (r[0], r[4])):
        by_rule.setdefault(rule[0], []).append(rule)
    found = []
    for rule_id, group in by_rule.items():
        hit = None
        for _, pattern, _, langs, _ in group:
            fits = F.col("line").rlike(f"(?i){pattern}") if is_regex(pattern) else F.lower("line").contains(pattern.lower())
            if langs:
                fits = fits & F.col("language").isin(*langs.split(","))
            hit = F.when(fits, pattern) if hit is None else hit.when(fits, pattern)
        found.append(F.struct(F.lit(rule_id).alias("rule_id"), F.lit(group[0][2]).alias("severity"), hit.alias("pattern")))
    rows = lines.where(~is_comment(F.col("line"))).select("file", "dir", "language", "line_no", F.explode(F.array(*found)).alias("f"))
    return rows.where("f.pattern is not null").select("file", "dir", "language", "line_no", "f.*")


def hits(text: Column, section: str, rules=TEXT_RULES) -> Column:
    """array<struct<category, pattern>>: the substring rules that a text holds. The rules are literals
    of the row's expression, so nothing is joined or shuffled."""
    listed = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern")) for c, s, p, _ in rules if s == section])
    return F.filter(listed, lambda r: text.contains(r["pattern"]))


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda r: r["category"]))), ",")


def multi_label(texts: DataFrame, section: str, rules=TEXT_RULES) -> DataFrame:
    """(key, labels): all categories of the section that a text (key, text) has, sorted."""
    return texts.select("key", hits(F.col("text"), section, rules).alias("f")).where(F.size("f") > 0).select("key", _labels(F.col("f")).alias("labels"))


def longest_match(texts: DataFrame, section: str, rules=TEXT_RULES) -> DataFrame:
    """(key, category): that of the longest pattern, ties to the first category."""
    best = F.array_min(F.transform("f", lambda r: F.struct((-F.length(r["pattern"])).alias("n"), r["category"].alias("category"))))
    return texts.select("key", hits(F.col("text"), section, rules).alias("f")).where(F.size("f") > 0).select("key", best["category"].alias("category"))


def taint_labels(texts: DataFrame, rules=TEXT_RULES) -> DataFrame:
    """(key, label, role): a source label wins over a sink label, excluded texts have no sink."""
    out = "|".join(p for _, s, p, _ in rules if s == "exclude")
    sink = F.when(F.lit(not out) | ~F.col("text").rlike(out or "$."), hits(F.col("text"), "sink", rules)).otherwise(F.slice(hits(F.col("text"), "sink", rules), 1, 0))
    rows = texts.select("key", hits(F.col("text"), "source", rules).alias("src"), sink.alias("snk")).where((F.size("src") > 0) | (F.size("snk") > 0))
    first = F.size("src") > 0
    return rows.select("key", F.when(first, _labels(F.col("src"))).otherwise(_labels(F.col("snk"))).alias("label"), F.when(first, "source").otherwise("sink").alias("role"))


def load_rules(text: str) -> list[tuple[str, str, str, str, int]]:
    """(language, section, category, pattern, order) rows of a rule file: JSON, or the part of YAML that nests
    mappings by two spaces and lists by dashes: language, category, section, patterns."""
    import json

    try:
        tree = json.loads(text)
    except ValueError:
        tree = _nested(text)
    rows = []
    for language, kinds in tree.items():
        for category, sections in kinds.items():
            if isinstance(sections, list):
                sections = {category: sections}
            for section, patterns in sections.items():
                rows += [(language, section, category, str(p), k) for k, p in enumerate(patterns or [])]
    return rows


def _nested(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict, str]] = [(-1, {"": root}, "")]
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        if bare.startswith("- "):
            holder, key = next((h, k) for d, h, k in reversed(stack) if d < depth or (d == depth and k))
            value = bare[2:].strip()
            if not isinstance(holder[key], list):
                holder[key] = []
            holder[key].append(value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value)
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        _, holder, key = stack[-1]
        name = bare.rstrip(":").strip().strip("\"'")
        if not isinstance(holder[key], dict):
            holder[key] = {}
        holder[key][name] = {}
        stack.append((depth, holder[key], name))
    return root


LANGUAGES, SECTIONS = ("python", "javascript", "java"), ("sources", "sinks", "sanitizers", "sink_excludes")


def rule_problems(rules: DataFrame) -> DataFrame:
    """(language, section, category, pattern, problem): rules of unknown languages or sections, empty or repeated ones."""
    rows = rules.withColumn("times", F.count("*").over(Window.partitionBy("language", "section", "category", "pattern")))
    problem = F.when(~F.col("language").isin(*LANGUAGES), "language").when(~F.col("section").isin(*SECTIONS), "section").when(F.trim("pattern") == "", "empty").when(F.col("times") > 1, "repeated")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("language", "section", "category", "pattern", "problem").distinct()


def rules_for(rules: DataFrame, language: str) -> DataFrame:
    """(category, sources, sinks, sanitizers) of a language."""
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("ord", "pattern"))))["pattern"].alias(s)
    return rules.where(F.col("language") == language).groupBy("category").agg(*map(listed, SECTIONS[:3]))


def patterns(rules: DataFrame, language: str, section: str) -> DataFrame:
    return rules.where((F.col("language") == language) & (F.col("section") == section)).select("pattern").distinct().orderBy("pattern")


def languages(rules: DataFrame) -> DataFrame:
    return rules.select("language").distinct().orderBy("language")


def find_nodes(nodes: DataFrame, pattern: str, columns: list[str], limit: int = 200) -> DataFrame:
    """The first nodes by id with the pattern in any of the columns; an empty pattern finds none."""
    if not pattern:
        return nodes.limit(0)
    hit = F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: x.contains(pattern))
    return nodes.where(hit).orderBy("node_id").limit(limit)
