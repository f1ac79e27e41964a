"""Queries over lines, rules, endpoints and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.operators import report, retrieval, rules
from graphlens.plans.registry import query
from graphlens.sources import bridge, files

LINES = "lines AS (SELECT file, dir, language, row_number() OVER (PARTITION BY file ORDER BY i) AS line_no, line FROM (SELECT doc_id AS file, source AS dir, lang AS language, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents))"
NOT_COMMENT = r"NOT regexp_matches(trim(line, ' '), '^(//|/\*|\*|#|<!--)')"


def _case(group) -> str:
    out = "CASE"
    for _, pattern, _, langs, _ in group:
        hit = f"regexp_matches(line, '(?i){pattern}')" if rules.is_regex(pattern) else f"contains(lower(line), '{pattern.lower()}')"
        if langs:
            hit += " AND language IN (" + ", ".join(f"'{x}'" for x in langs.split(",")) + ")"
        out += f" WHEN {hit} THEN '{pattern}'"
    return out + " END"


def _found() -> str:
    by_rule: dict = {}
    for r in sorted(rules.LINE_RULES, key=lambda r: (r[0], r[4])):
        by_rule.setdefault(r[0], []).append(r)
    parts = [f"SELECT file, dir, language, line_no, '{k}' AS rule_id, '{g[0][2]}' AS severity, {_case(g)} AS pattern FROM lines WHERE {NOT_COMMENT}" for k, g in by_rule.items()]
    return f"WITH {LINES}, found AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE pattern IS NOT NULL)"


FOUND = _found()
TEXT_VALUES = ", ".join(f"('{c}', '{s}', '{p}', {o})" for c, s, p, o in rules.TEXT_RULES)
TEXTS = f"rules(category, section, pattern, ord) AS (VALUES {TEXT_VALUES}), texts AS (SELECT doc_id AS key, lower(text) AS text FROM documents WHERE text IS NOT NULL)"


def _texts(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("key"), F.lower("text").alias("text"))


@query(f"{FOUND} SELECT rule_id, language, count(*) AS n FROM found GROUP BY ALL")
def q_rule_scan_lines(spark, sf_dir):
    return rules.scan_lines(bridge.lines(spark, sf_dir)).groupBy("rule_id", "language").agg(F.count("*").alias("n"))


@query(f"{FOUND} SELECT file, line_no, rule_id, pattern FROM found")
def q_first_pattern_per_line(spark, sf_dir):
    return rules.scan_lines(bridge.lines(spark, sf_dir)).select("file", "line_no", "rule_id", "pattern")


@query(f"WITH {LINES} SELECT dir, language, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY ALL")
def q_scan_lines(spark, sf_dir):
    return bridge.lines(spark, sf_dir).groupBy("dir", "language").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {LINES} SELECT language, count(*) FILTER (WHERE {NOT_COMMENT}) AS code, count(*) FILTER (WHERE NOT ({NOT_COMMENT})) AS comments FROM lines GROUP BY language")
def q_comment_filter(spark, sf_dir):
    out = rules.is_comment(F.col("line"))
    return bridge.lines(spark, sf_dir).groupBy("language").agg(F.count_if(~out).alias("code"), F.count_if(out).alias("comments"))


@query(f"{FOUND} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def q_severity_counts(spark, sf_dir):
    return rules.scan_lines(bridge.lines(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"{FOUND} SELECT substr(sha256(rule_id || '|' || file || '|' || line_no), 1, 16) AS finding_id, rule_id, dense_rank() OVER (ORDER BY rule_id) - 1 AS rule_index, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM found")
def q_sarif_rules(spark, sf_dir):
    found = rules.scan_lines(bridge.lines(spark, sf_dir))
    # the rule table is small: it is ranked by itself, not by a window over all findings
    index = found.select("rule_id").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")).cast("long") - 1)
    return found.join(F.broadcast(index), "rule_id").select(
        F.substring(F.sha2(F.concat_ws("|", "rule_id", "file", "line_no"), 256), 1, 16).alias("finding_id"), "rule_id", "rule_index",
        F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note").alias("level"),
    )


@query(f"{FOUND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY file, line_no) AS rn FROM found) SELECT rule_id, file, line_no, split_part(rule_id, '-', 1) || '-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS owasp_id FROM ranked")
def q_owasp_ids(spark, sf_dir):
    found = report.numbered(rules.scan_lines(bridge.lines(spark, sf_dir)), "rule_id", ["file", "line_no"], F.floor(F.col("file") / report.BUCKET))
    return found.select("rule_id", "file", "line_no", F.concat_ws("-", F.split("rule_id", "-")[0], report.padded(F.col("rn"))).alias("owasp_id"))


@query(f"{FOUND}, around AS (SELECT f.file, f.line_no, f.rule_id, l.line_no AS at, length(l.line) AS n FROM found f JOIN lines l ON l.file = f.file AND l.line_no BETWEEN f.line_no - 2 AND f.line_no + 2) SELECT file, line_no, rule_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars FROM around GROUP BY ALL")
def q_context_lines(spark, sf_dir):
    lines = bridge.lines(spark, sf_dir)
    found = rules.scan_lines(lines).select("file", "line_no", "rule_id")
    return retrieval.context(lines, found, 2).groupBy("file", "line_no", "rule_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {TEXTS} SELECT key, string_agg(DISTINCT category, ',' ORDER BY category) AS labels FROM texts JOIN rules ON section = 'source' AND contains(text, pattern) GROUP BY key")
def q_multi_label(spark, sf_dir):
    return rules.multi_label(_texts(spark, sf_dir), "source")


@query(f"WITH {TEXTS} SELECT key, category FROM (SELECT key, category, row_number() OVER (PARTITION BY key ORDER BY length(pattern) DESC, category) AS rn FROM texts JOIN rules ON section = 'sink' AND contains(text, pattern)) WHERE rn = 1")
def q_longest_match(spark, sf_dir):
    return rules.longest_match(_texts(spark, sf_dir), "sink")


@query(f"WITH {TEXTS} SELECT category, section, count(*) AS n FROM texts JOIN rules ON section <> 'exclude' AND contains(text, pattern) GROUP BY ALL")
def q_rule_scan_substring(spark, sf_dir):
    found = lambda s: F.transform(rules.hits(F.col("text"), s), lambda r: F.struct(r["category"].alias("category"), F.lit(s).alias("section")))
    return _texts(spark, sf_dir).select(F.explode(F.concat(found("source"), found("sink"))).alias("f")).groupBy("f.category", "f.section").agg(F.count("*").alias("n"))


@query(f"""WITH {TEXTS}, s AS (SELECT key, string_agg(DISTINCT category, ',' ORDER BY category) AS l FROM texts JOIN rules ON section = 'source' AND contains(text, pattern) GROUP BY key),
k AS (SELECT key, string_agg(DISTINCT category, ',' ORDER BY category) AS l FROM texts JOIN rules ON section = 'sink' AND contains(text, pattern) WHERE NOT regexp_matches(text, 'junk|spam') GROUP BY key)
SELECT coalesce(s.key, k.key) AS key, coalesce(s.l, k.l) AS label, CASE WHEN s.l IS NOT NULL THEN 'source' ELSE 'sink' END AS role FROM s FULL JOIN k ON s.key = k.key""")
def q_sink_exclude(spark, sf_dir):
    return rules.taint_labels(_texts(spark, sf_dir))


@query("SELECT p_partkey AS part, 'part:' || p_partkey AS node_id FROM part WHERE contains(p_name, '7') OR contains(p_brand, '7') ORDER BY node_id LIMIT 200")
def q_find_nodes(spark, sf_dir):
    part = bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), S.uid(F.lit("part"), "p_partkey").alias("node_id"), "p_name", "p_brand")
    return rules.find_nodes(part, "7", ["p_name", "p_brand"]).select("part", "node_id")


WORDS = "words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))) AS term FROM documents)"


@query(f"WITH {WORDS} SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc FROM words WHERE length(term) >= 3 GROUP BY term")
def q_inverted_index(spark, sf_dir):
    index = retrieval.inverted_index(bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text"))
    return index.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("chunk").alias("first_doc"))


@query(f"WITH {LINES} SELECT file, line_no, regexp_extract(line, '[0-9]+@mail[0-9]', 0) AS hit FROM lines WHERE regexp_matches(line, '[0-9]+@mail[0-9]')")
def q_search_regex(spark, sf_dir):
    return retrieval.search(bridge.lines(spark, sf_dir), "[0-9]+@mail[0-9]")


@query(f"""WITH {LINES}, hits AS (SELECT file, line_no FROM lines WHERE regexp_matches(line, 'token')),
chunks AS (SELECT file, (line_no - 1) // 5 AS chunk, min(line_no) AS lo, max(line_no) AS hi FROM lines GROUP BY ALL)
SELECT h.file, h.line_no, c.chunk, c.hi - c.lo + 1 AS size FROM hits h JOIN chunks c ON h.file = c.file AND h.line_no BETWEEN c.lo AND c.hi""")
def q_chunk_range_join(spark, sf_dir):
    lines = bridge.lines(spark, sf_dir)
    chunks = lines.groupBy("file", F.floor((F.col("line_no") - 1) / 5).alias("chunk")).agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    hits = lines.where(F.col("line").rlike("token")).select("file", "line_no")
    return retrieval.tightest(hits, chunks).select("file", "line_no", "chunk", (F.col("hi") - F.col("lo") + 1).alias("size"))


@query(f"""WITH {WORDS}, dw AS (SELECT * FROM words WHERE length(term) >= 3), bw AS (SELECT item_id AS query, term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS term FROM benchmark) WHERE length(term) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY ALL), m AS (SELECT query, count(*) AS m FROM bw GROUP BY ALL), k AS (SELECT query, doc_id, count(*) AS k FROM dw JOIN bw USING (term) GROUP BY ALL),
s AS (SELECT query, doc_id AS chunk, round(k / (n + m - k), 6) AS score FROM k JOIN n USING (doc_id) JOIN m USING (query))
SELECT query, chunk, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rn FROM s) WHERE rn <= 10""")
def q_search_similar(spark, sf_dir):
    """The ten chunks most like each benchmark text by token overlap; ties to the lower id."""
    docs = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text")
    asked = bridge.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.similar(docs, asked, 10)


ENDPOINTS = """e AS (SELECT page_id AS endpoint_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS route, ['GET', 'POST', 'PUT', 'DELETE'][page_id % 4 + 1] AS method, page_id % 3 = 0 AS auth_required,
len(regexp_extract_all(url, '[?&]([^=&]*)=', 1)) AS n_params, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links FROM pages),
scored AS (SELECT *, CAST(greatest(1, least(10, 1 + CASE method WHEN 'DELETE' THEN 3 WHEN 'GET' THEN 0 ELSE 2 END + least(4, n_params) + CASE WHEN auth_required THEN -1 WHEN method = 'GET' THEN 1 ELSE 3 END
+ CASE WHEN regexp_matches(lower(route), '""" + "|".join(S.ADMIN_WORDS) + """') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(route), '""" + "|".join(S.FILE_WORDS) + """') THEN 3 ELSE 0 END)) AS INTEGER) AS score FROM e),
kinds AS (SELECT *, CASE """ + " ".join(f"WHEN regexp_matches(lower(route), '{'|'.join(words)}') THEN '{name}'" for name, words in S.CATEGORY_WORDS) + """
WHEN NOT auth_required AND (method <> 'GET' OR regexp_matches(lower(route), '""" + "|".join(S.LOGIN_WORDS) + """')) THEN 'auth_bypass' WHEN method <> 'GET' THEN 'data_mutation' WHEN NOT auth_required THEN 'public_read' ELSE 'unknown' END AS category FROM scored)"""


def _scored(spark, sf_dir):
    e = bridge.endpoints(spark, sf_dir)
    c = F.col
    e = e.withColumn("score", S.endpoint_score(c("method"), c("n_params"), c("auth_required"), c("route")))
    return e.withColumn("category", S.category(c("method"), c("auth_required"), c("route")))


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, method, score FROM kinds")
def q_attack_surface_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("endpoint_id", "method", "score")


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, score FROM kinds ORDER BY score DESC, endpoint_id LIMIT 50")
def q_attack_surface_topk(spark, sf_dir):
    return _scored(spark, sf_dir).orderBy(F.desc("score"), "endpoint_id").limit(50).select("endpoint_id", "score")


@query(f"WITH {ENDPOINTS} SELECT category, count(*) AS n, count(*) FILTER (WHERE score >= 7) AS high, count(*) FILTER (WHERE score BETWEEN 4 AND 6) AS medium FROM kinds GROUP BY category")
def q_category_counts(spark, sf_dir):
    score = F.col("score")
    return _scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if(score >= 7).alias("high"), F.count_if(score.between(4, 6)).alias("medium"))


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, method || ' ' || route AS endpoint FROM kinds WHERE NOT auth_required")
def q_missing_auth(spark, sf_dir):
    return bridge.endpoints(spark, sf_dir).where("not auth_required").select("endpoint_id", F.concat_ws(" ", "method", "route").alias("endpoint"))


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, route FROM e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.endpoint_id AND contains(d.text, 'the ')) ")
def q_endpoints_without_source(spark, sf_dir):
    labelled = bridge.table(spark, sf_dir, "documents").where(F.col("text").contains("the ")).select(F.col("doc_id").alias("endpoint_id"))
    return bridge.endpoints(spark, sf_dir).join(labelled, "endpoint_id", "left_anti").select("endpoint_id", "route")


@query(f"WITH {ENDPOINTS} SELECT endpoint_id, CASE WHEN regexp_replace(route, '^/+', '') = '' THEN '/api' ELSE '/api/' || regexp_replace(route, '^/+', '') END AS merged FROM e")
def q_merge_routes(spark, sf_dir):
    return bridge.endpoints(spark, sf_dir).select("endpoint_id", S.merge_routes(F.lit("api/"), F.col("route")).alias("merged"))


@query("SELECT doc_id, regexp_extract(line, '^([^:=]+)[:=]', 1) AS key, CAST(length(line) AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[^:=]+[:=]') AND NOT regexp_matches(line, '^[#!]')")
def q_properties_parse(spark, sf_dir):
    split = F.explode(F.split("text", "\n")).alias("line")
    rows = bridge.table(spark, sf_dir, "documents").select("doc_id", split)
    return files.properties(rows).select("doc_id", "key", F.length("line").alias("n"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def q_json_props(spark, sf_dir):
    return bridge.calls(spark, sf_dir).groupBy(F.col("phase").alias("event_type"), "k").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(p_size // 10 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR) AS version, p_size < 25 AS below FROM part")
def q_version_compare(spark, sf_dir):
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10)
    return bridge.table(spark, sf_dir, "part").select("p_partkey", v.alias("version"), S.version_below(v, F.lit("2.5")).alias("below"))


@query("WITH e AS (SELECT doc_id || ':' || length(text) AS e, CAST('0x' || substr(sha256(doc_id || ':' || length(text)), 1, 2) AS INTEGER) % 64 AS part FROM documents), h AS (SELECT part, sha256(string_agg(e, chr(10) ORDER BY e)) AS h FROM e GROUP BY part) SELECT sha256(string_agg(h, chr(10) ORDER BY part)) AS fingerprint FROM h")
def q_source_fingerprint(spark, sf_dir):
    entry = F.concat_ws(":", "doc_id", F.length("text"))
    return files.fingerprint(bridge.table(spark, sf_dir, "documents").select(entry.alias("entry")))


@query()
def q_extract_functions(spark, sf_dir):
    """Functions, calls, assignments and routes of made Python sources, by the front end."""
    return files.extract_python(files.sample_sources(spark, bridge.table(spark, sf_dir, "nation"))).groupBy("kind").agg(F.count("*").alias("n"))
