"""Reports of findings (rule_id, severity, title, description, file, line, code, category, remediation)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.functions import vulnerabilities as V

EXTRA = ("cwe_id", "cvss_score", "cvss_vector", "endpoint", "http_method", "impact", "source_location", "sink_location", "validation_verdict", "validation_confidence", "validation_reasoning")
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
BUCKET = 1024


def finding_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "rule_id", "file", "line"), 256), 1, 16)


def enriched(findings: DataFrame) -> DataFrame:
    """Adds weakness, score and vector, impact, endpoint and method, each looked up by type."""
    kind = F.col("category")
    score = V.cvss_of(kind, F.col("severity"))
    return findings.withColumns({
        "cwe_id": V.cwe_of(kind), "cvss_score": score["score"], "cvss_vector": score["vector"], "impact": V.impact(kind),
        "endpoint": V.likely_endpoint(F.col("file"), kind), "http_method": V.likely_method(kind, F.coalesce("code", F.lit(""))),
    })


def finding_json(findings: DataFrame) -> DataFrame:
    """(id, json): a finding as an object; empty extra fields are left out."""
    main = ("rule_id", "severity", "title", "description", "file", "line", "code", "category", "remediation")
    lean = [F.when(F.col(c).cast("string").isin("", "0", "0.0"), None).otherwise(F.col(c)).alias(c) for c in EXTRA if c in findings.columns]
    return findings.select(finding_id().alias("id"), F.to_json(F.struct(finding_id().alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "line" else F.coalesce("line", F.lit(0)).alias("line") for c in main], *lean)).alias("json"))


def numbered(rows: DataFrame, group: str, order: list[str], range_of: Column) -> DataFrame:
    """Adds ``rn``: the place of a row in its group. Ranges of a group are counted first, so that a
    group with a third of all rows is numbered in many tasks. ``range_of`` must not fall as ``order`` rises."""
    rows = rows.withColumn("__range", range_of)
    counts = rows.groupBy(group, "__range").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.sum("n").over(Window.partitionBy(group).orderBy("__range")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    return rows.withColumn("rn", inside).join(before, [group, "__range"]).withColumn("rn", F.col("rn") + F.col("__before")).drop("__range", "__before")


def padded(n: Column) -> Column:
    """At least three digits."""
    text = n.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def owasp_ids(findings: DataFrame, order: list[str], range_of: Column) -> DataFrame:
    """Adds section, and owasp_id such as INJ-001: running numbers by prefix."""
    rows = findings.withColumn("__s", V.section_of(F.col("category"))).withColumns({"section": F.col("__s.section"), "prefix": F.col("__s.prefix")}).drop("__s")
    return numbered(rows, "prefix", order, range_of).withColumn("owasp_id", F.concat_ws("-", "prefix", padded(F.col("rn")))).drop("rn")


def sarif_rules(findings: DataFrame, order: Column) -> DataFrame:
    """(rule_id, rule_index, rule): rules in the order in which they are first seen, as JSON objects."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct(order.alias("o"), "title", "remediation", "description", "severity")).alias("f"))
    index = F.row_number().over(Window.orderBy("f.o", "rule_id")).cast("long") - 1  # rules are few
    rule = F.struct(
        F.col("rule_id").alias("id"), F.struct(F.col("f.title").alias("text")).alias("shortDescription"),
        F.struct(F.col("f.remediation").alias("text"), F.col("f.description").alias("markdown")).alias("help"),
        F.struct(S.lookup(F.col("f.severity"), S.SEVERITY_SCORE, 5.0).alias("security-severity")).alias("properties"),
    )
    return first.select("rule_id", index.alias("rule_index"), F.to_json(rule).alias("rule"))


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, file, line, result): results as JSON objects; the rule's index is its place among the rules."""
    place = F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"))).alias("region"),
        F.when(F.coalesce("code", F.lit("")) != "", F.struct(F.struct(F.col("code").alias("text")).alias("snippet"))).alias("contextRegion"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), V.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat(F.col("title"), F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, 200)).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    return findings.join(F.broadcast(rules.select("rule_id", "rule_index")), "rule_id").select("rule_id", "file", "line", F.to_json(result).alias("result"))


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def write_sarif(findings: DataFrame, path: str, order: Column, version: str = "1") -> None:
    """One document under ``path``; results stream to it one by one, so their number is not bounded by memory."""
    rules = sarif_rules(findings, order).orderBy("rule_index")
    head = {"$schema": SARIF_SCHEMA, "version": "2.1.0"}
    with Path(path).open("w", encoding="utf-8") as out:
        listed = ",".join(r["rule"] for r in rules.collect())
        out.write(json.dumps(head)[:-1] + f', "runs": [{{"tool": {{"driver": {{"name": "graphlens", "version": {json.dumps(version)}, "rules": [{listed}]}}}}, "results": [')
        for k, r in enumerate(sarif_results(findings, rules).orderBy("file", "line", "rule_id").toLocalIterator()):
            out.write((",\n" if k else "") + r["result"])
        out.write("]}]}")


def write_json(findings: DataFrame, path: str, info: dict) -> None:
    """scan_info, counts and findings as one document, findings one by one."""
    counts = {r["severity"]: r["n"] for r in severities(findings).collect()}
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(f'{{"scan_info": {json.dumps(info)}, "total": {sum(counts.values())}, "severity_counts": {json.dumps(counts, sort_keys=True)}, "findings": [')
        for k, r in enumerate(finding_json(findings).orderBy("id").toLocalIterator()):
            out.write((",\n" if k else "") + r["json"])
        out.write("]}")


def markdown(findings: DataFrame, info: dict, order: list[str], range_of: Column):
    """Lines of a report: summary, then each section in its order with its findings."""
    yield f"# Audit of {info.get('project', '')}"
    yield ""
    yield "| Severity | Findings |"
    yield "|---|---|"
    counts = {r["severity"]: r["n"] for r in severities(findings).collect()}
    yield from (f"| {s} | {counts[s]} |" for s in (*V.SEVERITIES, "info") if s in counts)
    rows = owasp_ids(enriched(findings), order, range_of).withColumn("rank", V.section_rank(F.col("section")))
    section = None
    for r in rows.orderBy("rank", "owasp_id").toLocalIterator():
        if r["section"] != section:
            section = r["section"]
            yield from ("", f"## {section}")
        yield from ("", f"### {r['owasp_id']} {r['title']}", "", f"{r['severity']}, {r['cwe_id'] or 'no weakness named'}, score {r['cvss_score']}: `{r['file']}:{r['line']}`", "", r["impact"])


def write_report(findings: DataFrame, path: str, form: str, info: dict, order: list[str], range_of: Column) -> None:
    """json, markdown or sarif."""
    if form == "json":
        write_json(enriched(findings), path, info)
    elif form == "sarif":
        write_sarif(findings, path, F.struct(*order))
    elif form == "markdown":
        with Path(path).open("w", encoding="utf-8") as out:
            out.writelines(x + "\n" for x in markdown(findings, info, order, range_of))
    else:
        raise ValueError(f"unknown form of a report: {form}")


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) Prometheus text of metrics (name, labels map<string,string>, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"')))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def tool_calls(calls: DataFrame) -> DataFrame:
    """Tool calls (tool, ok, seconds) counted as calls of the model ``tool``."""
    return calls.groupBy(F.lit("tool").alias("model"), F.col("tool").alias("phase"), F.when(F.col("ok"), "success").otherwise("error").alias("status")).agg(
        F.count("*").alias("n"), F.sum("seconds").alias("seconds")
    )
