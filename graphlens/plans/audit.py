"""Queries of lookups, validation, evaluation, reports, and of the front ends on made sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.functions import vulnerabilities as V
from graphlens.operators import annotate, report, rules, sessions
from graphlens.plans.registry import query
from graphlens.plans.scans import FOUND, LINES
from graphlens.sources import braces, bridge, configuration, endpoints, files, flow

KINDS = tuple(V.CWE_OF) + ("race_condition", "odd")
KIND = f"[{', '.join(repr(k) for k in KINDS)}][p_partkey % {len(KINDS)} + 1]"
SEVERITY = "['critical', 'high', 'medium', 'low', 'info'][p_size % 5 + 1]"


def _values(rows, columns: str) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def _kinds(spark, sf_dir):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", "p_size", pick(KINDS, F.col("p_partkey")).alias("kind"), pick((*V.SEVERITIES, "info"), F.col("p_size")).alias("severity"))


@query(f"""WITH p AS (SELECT p_partkey, {KIND} AS kind, {SEVERITY} AS severity FROM part), c AS (SELECT * FROM {_values([(k, s, *v) for (k, s), v in V.CVSS.items()], 'kind, severity, score, vector')}),
f AS (SELECT * FROM {_values([(k, *v) for k, v in V.FALLBACK.items() if k], 'severity, score, vector')}),
best AS (SELECT kind, arg_min(score, r) AS score, arg_min(vector, r) AS vector FROM (SELECT *, list_position(['critical', 'high', 'medium', 'low'], severity) AS r FROM c) GROUP BY kind)
SELECT p_partkey, CAST(coalesce(c.score, best.score, f.score, 5.0) AS DOUBLE) AS score, 'CVSS:3.1/AV:N/' || coalesce(c.vector, best.vector, f.vector, '{V.FALLBACK[""][1]}') AS vector
FROM p LEFT JOIN c ON c.kind = p.kind AND c.severity = p.severity LEFT JOIN best ON best.kind = p.kind LEFT JOIN f ON f.severity = p.severity""")
def q_cvss_lookup(spark, sf_dir):
    """Type and severity, else the type's highest severity, else the severity alone."""
    score = V.cvss_of(F.col("kind"), F.col("severity"))
    return _kinds(spark, sf_dir).select("p_partkey", score["score"].alias("score"), score["vector"].alias("vector"))


@query(f"""WITH p AS (SELECT p_partkey, {KIND} AS kind FROM part), w AS (SELECT * FROM {_values(V.CWE_OF.items(), 'kind, cwe')}), n AS (SELECT * FROM {_values(V.CWE_NAMES.items(), 'cwe, name')}),
s AS (SELECT * FROM {_values([(k, s, p, d) for s, p, kinds in V.SECTIONS for k, d in kinds.items()], 'kind, section, prefix, display')})
SELECT p_partkey, coalesce(w.cwe, '') AS cwe, coalesce(n.name, '') AS name, coalesce(section, 'Other') AS section, coalesce(prefix, 'OTHER') AS prefix, coalesce(display, p.kind) AS display
FROM p LEFT JOIN w ON w.kind = p.kind LEFT JOIN n ON n.cwe = w.cwe LEFT JOIN s ON s.kind = p.kind""")
def q_weakness_lookup(spark, sf_dir):
    kind, cwe = F.col("kind"), V.cwe_of(F.col("kind"))
    return _kinds(spark, sf_dir).select("p_partkey", cwe.alias("cwe"), V.cwe_name(cwe).alias("name"), V.section_of(kind).alias("s")).select("p_partkey", "cwe", "name", "s.section", "s.prefix", "s.display")


@query(f"WITH p AS (SELECT p_partkey, p_size, {KIND} AS kind FROM part) SELECT p_partkey, CASE WHEN issues = 2 THEN 'rejected' WHEN issues = 1 THEN 'inconclusive' ELSE 'confirmed' END AS verdict, round(least(1.0, confidence * CASE issues WHEN 2 THEN 0.3 WHEN 1 THEN 0.7 ELSE 1.1 END), 6) AS confidence FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS confidence, CASE WHEN p_partkey % 3 = 0 AND kind NOT IN ('xss', 'ssrf') THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 AND kind <> 'xss' THEN 1 ELSE 0 END AS issues FROM p)")
def q_l1_validation(spark, sf_dir):
    """Claimed types against those that rules see at the source of a third and the sink of a half."""
    rows = _kinds(spark, sf_dir).select(F.col("p_partkey").alias("id"), "kind", (F.col("p_size") / 50).alias("confidence"))
    source = rows.where("id % 3 = 0").select("id", F.array(F.lit("xss"), F.lit("ssrf")).alias("kinds"))
    sink = rows.where("id % 2 = 0").select("id", F.lit("xss").alias("kind"))
    return annotate.validate_l1(rows, source, sink).select(F.col("id").alias("p_partkey"), "verdict", F.round("confidence", 6).alias("confidence"))


MEMBERS = tuple(sorted({c for f in V.FAMILIES for c in f}))
PAIR = f"SELECT p_partkey, m[p_partkey % {len(MEMBERS)} + 1] AS a, m[p_size % {len(MEMBERS)} + 1] AS b FROM part, (SELECT [{', '.join(repr(c) for c in MEMBERS)}] AS m)"


@query(f"WITH p AS ({PAIR}), f AS (SELECT * FROM {_values([(k, c) for k, f in enumerate(V.FAMILIES) for c in f], 'family, cwe')}) SELECT p_partkey, CAST(CASE WHEN a = b THEN 1.0 WHEN EXISTS (SELECT 1 FROM f x JOIN f y ON x.family = y.family WHERE x.cwe = a AND y.cwe = b) THEN 0.7 ELSE 0.3 END AS DOUBLE) AS score FROM p")
def q_eval_cwe_score(spark, sf_dir):
    pick = lambda c: F.element_at(F.array(*map(F.lit, MEMBERS)), (F.col(c) % len(MEMBERS) + 1).cast("int"))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", V.cwe_score(pick("p_partkey"), pick("p_size")).alias("score"))


@query(f"WITH p AS (SELECT p_partkey, p_size, {KIND} AS kind FROM part) SELECT p_partkey, CAST(CASE WHEN kind = 'sql_injection' THEN 1.0 WHEN contains('sql_injection', kind) OR contains(kind, 'sql_injection') THEN 0.5 ELSE 0 END AS DOUBLE) AS type_score, CAST(CASE abs(p_size % 5 - 2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 END AS DOUBLE) AS severity_score, CAST(CASE p_partkey % 3 WHEN 2 THEN 0.5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END END AS DOUBLE) AS verdict_score FROM p")
def q_eval_metrics(spark, sf_dir):
    """The scores of a golden case: type, severity and verdict, negative cases mirrored."""
    verdict = F.element_at(F.array(F.lit("confirmed"), F.lit("rejected"), F.lit("inconclusive")), (F.col("p_partkey") % 3 + 1).cast("int"))
    distance = F.abs(F.col("p_size") % 5 - 2).cast("int")
    return _kinds(spark, sf_dir).select("p_partkey", V.type_score(F.col("kind"), F.lit("sql_injection")).alias("type_score"), V.severity_score(distance).alias("severity_score"), V.verdict_score(verdict, F.col("p_size") % 2 == 0).alias("verdict_score"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, CASE event_type WHEN 'purchase' THEN ln(0.95 / 0.1) WHEN 'click' THEN ln(0.1 / 0.85) ELSE 0 END AS w FROM events),
o AS (SELECT user_id, step, ln(0.6 / 0.4) + sum(w) OVER (PARTITION BY user_id ORDER BY step) AS odds FROM e) SELECT user_id, step, round(1 / (1 + exp(-odds)), 6) AS posterior FROM o""")
def q_belief_history(spark, sf_dir):
    kind = F.col("event_type")
    rows = bridge.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("finding"), F.col("event_id").alias("at"), F.lit(0.6).alias("initial"),
        F.when(kind == "purchase", 0.95).when(kind == "click", 0.1).otherwise(0.5).alias("given"), F.when(kind == "purchase", 0.1).when(kind == "click", 0.85).otherwise(0.5).alias("otherwise"),
    )
    from pyspark.sql import Window

    steps = rows.withColumn("step", F.row_number().over(Window.partitionBy("finding").orderBy("at")).cast("long"))
    return sessions.belief_history(steps).select(F.col("finding").alias("user_id"), "step", F.round("posterior", 6).alias("posterior"))


DANGER = " OR ".join(f"contains(lower(line), '{w}')" for w in annotate.DANGER)


@query(f"WITH {LINES} SELECT file, line_no FROM lines WHERE contains(line, '(') AND ({DANGER})")
def q_unlabeled_dangerous(spark, sf_dir):
    rows = bridge.lines(spark, sf_dir).select("file", "line_no", F.lit("assignment").alias("node_type"), F.lit(None).cast("string").alias("taint"), F.col("line").alias("source"))
    return annotate.unlabelled_dangerous(rows).select("file", "line_no")


@query(f"WITH {LINES} SELECT file, count(*) AS n FROM lines WHERE contains(line, '(') GROUP BY file")
def q_sink_candidates(spark, sf_dir):
    rows = bridge.lines(spark, sf_dir).select("file", F.col("line_no").alias("line"), F.lit("assignment").alias("node_type"), F.lit(None).cast("string").alias("taint"), F.col("line").alias("source"))
    return annotate.candidates(rows).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"'{w}'" for w in annotate.KEYWORDS) + "], lambda w: contains(lower(text), w))), ',') AS words FROM documents WHERE text IS NOT NULL")
def q_keywords(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(annotate.keywords_in(F.col("text")), ",").alias("words"))


@query(f"""{FOUND}, first AS (SELECT rule_id, min((file, line_no)) AS f FROM found GROUP BY rule_id), idx AS (SELECT rule_id, row_number() OVER (ORDER BY f, rule_id) - 1 AS i FROM first)
SELECT file, line_no, rule_id, i AS rule_index, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM found JOIN idx USING (rule_id)""")
def q_sarif_results(spark, sf_dir):
    """Read back from the SARIF objects: rules are numbered in the order in which they are first seen."""
    none = F.lit("")
    found = rules.scan_lines(bridge.lines(spark, sf_dir)).select("rule_id", "severity", "file", F.col("line_no").alias("line"), F.col("rule_id").alias("title"), none.alias("description"), none.alias("remediation"), none.alias("code"))
    made = report.sarif_results(found, report.sarif_rules(found, F.struct("file", "line")))
    return made.select("file", F.col("line").alias("line_no"), "rule_id", F.get_json_object("result", "$.ruleIndex").cast("long").alias("rule_index"), F.get_json_object("result", "$.level").alias("level"))


@query("SELECT 'calls_total{phase=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def q_prometheus_text(spark, sf_dir):
    counts = bridge.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return report.exposition(counts.select(F.lit("calls_total").alias("name"), F.create_map(F.lit("phase"), F.col("event_type")).alias("labels"), "value"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) ELSE (ms // 60000) || 'm ' || ((ms // 1000) % 60) || 's' END AS took FROM (SELECT event_id, CAST((event_id * 731) % 200000 AS BIGINT) // 50 * 50 AS ms FROM events) WHERE ms % 100 = 0")
def q_duration_text(spark, sf_dir):
    ms = F.floor((F.col("event_id") * 731) % 200000 / 50) * 50
    return bridge.table(spark, sf_dir, "events").select("event_id", ms.alias("ms")).where("ms % 100 = 0").select("event_id", V.duration(F.col("ms")).alias("took"))


SOURCES = {
    "app/main.py": "from app.db import find\nfrom .util import clean\n\ndef view(request):\n    q = request.args\n    if q:\n        q = clean(q)\n    else:\n        return None\n    for x in q:\n        if x == 'stop':\n            break\n        find(x)\n    return q\n",
    "app/db.py": "def find(name):\n    sql = 'select ' + name\n    try:\n        return run(sql)\n    except ValueError:\n        raise\n\ndef run(text):\n    return text\n",
    "app/util.py": "def clean(value):\n    while value:\n        value = value[1:]\n        continue\n    return value\n",
}


def made(spark, sources: dict[str, str]):
    language = {"py": "python", "js": "javascript", "java": "java"}
    return spark.createDataFrame([(p, language.get(p.rsplit(".", 1)[-1]), c) for p, c in sources.items()], "path string, language string, content string")


@query("SELECT * FROM " + _values([
    ("find", "entry", 1, 0), ("find", "exit", 6, 0), ("find", "basic", 2, 1), ("find", "try", 3, 1), ("find", "basic", 4, 1), ("find", "except", 5, 1), ("find", "basic", 6, 1),
    ("run", "entry", 8, 0), ("run", "exit", 9, 0), ("run", "basic", 9, 1),
], "function, kind, line, reached"))
def q_flow_blocks(spark, sf_dir):
    """Basic blocks of two functions; reached: whether another block leads to one that is neither entry nor exit."""
    nodes, edges = flow.property_graph(made(spark, {"app/db.py": SOURCES["app/db.py"]}))
    kinds = ("entry", "exit", "basic", "try", "basic", "except", "basic")
    blocks = nodes.where("node_type = 'basic_block'").join(edges.where("edge_type = 'CTRL_FLOW'").select(F.col("dst").alias("node_id")).distinct().withColumn("in", F.lit(1)), "node_id", "left")
    kind = F.when(F.col("position") > 1, F.element_at(F.array(*map(F.lit, kinds)), F.col("position") + 1)).otherwise(F.when(F.col("position") == 0, "entry").otherwise("exit"))
    return blocks.select("function", kind.alias("kind"), "line", F.when(F.col("position") > 1, F.coalesce("in", F.lit(0))).otherwise(0).alias("reached"))


@query("SELECT * FROM " + _values([
    ("branch_true", 4), ("branch_false", 4), ("fallthrough", 9), ("break", 1), ("loop_back", 1), ("continue", 1), ("exception", 2), ("return", 5),
], "kind, n"))
def q_flow_edges(spark, sf_dir):
    """Control edges by kind over three files."""
    return flow.property_graph(made(spark, SOURCES))[1].where("edge_type = 'CTRL_FLOW'").groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM " + _values([("app/main.py", "app/db.py"), ("app/main.py", "app/util.py")], "path, target"))
def q_import_resolution(spark, sf_dir):
    sources = made(spark, SOURCES)
    facts = files.extract_python(sources).where("kind = 'import'").select("path", F.col("name").alias("module"), F.col("detail").alias("name"))
    return flow.module_paths(facts, sources).select("path", "target").distinct()


@query("SELECT * FROM " + _values([("app/main.py", 7, "app/util.py", "clean"), ("app/main.py", 13, "app/db.py", "find")], "file, line, target, callee"))
def q_cross_file_calls(spark, sf_dir):
    sources = made(spark, SOURCES)
    facts = files.extract_python(sources).where("kind = 'import'").select("path", F.col("name").alias("module"), F.col("detail").alias("name"))
    nodes, edges = flow.property_graph(sources)
    across = flow.linked(nodes, edges, flow.module_paths(facts, sources)).where("kind = 'cross_file' and edge_type = 'CALLS'")
    ends = lambda i, *c: nodes.select(F.col("node_id").alias(i), *c)
    return across.join(ends("src", "file", "line"), "src").join(ends("dst", F.col("file").alias("target"), F.col("name").alias("callee")), "dst").select("file", "line", "target", "callee")


WEB = {
    "flask_app.py": "from flask import Flask\n@app.route('/items/<int:item>', methods=['GET', 'POST'])\n@login_required\ndef items(item):\n    return item\n",
    "fast.py": "from fastapi import FastAPI, Query\n@app.get('/search/{kind}')\ndef search(kind, q=Query(None)):\n    return q\n",
    "urls.py": "from django.urls import path\nurlpatterns = [path('news/<slug:name>/', views.news)]\n", "views.py": "def news(request, name):\n    return name\n",
    "app.js": "const express = require('express');\nconst app = express();\napp.get('/users/:id', requireAuth, showUser);\napp.post('/users', addUser);\nfunction showUser(req, res) { res.send(req.params.id); }\nfunction addUser(req, res) { save(req.body); }\n",
    "Api.java": "package x;\nimport org.springframework.web.bind.annotation.GetMapping;\n@RequestMapping(\"/api\")\npublic class Api {\n  @GetMapping(\"/list/{id}\")\n  @PreAuthorize(\"x\")\n  public String list(@PathVariable String id, @RequestParam String q) { return q; }\n}\n",
    "Rest.java": "import jakarta.ws.rs.GET;\n@Path(\"/r\")\nclass Rest {\n  @POST\n  @Path(\"in\")\n  public void in(@FormParam(\"a\") String a) { use(a); }\n}\n",
}


@query("SELECT * FROM " + _values([
    ("/items/<int:item>", "GET,POST", "items", "item:path", 1), ("/search/{kind}", "GET", "search", "kind:path,q:query", 0), ("/news/<slug:name>/", "ANY", "news", "name:path", 0),
    ("/users/:id", "GET", "showUser", "id:path", 1), ("/users", "POST", "addUser", "", 0), ("/api/list/{id}", "GET", "list", "id:path,q:query", 1), ("/r/in", "POST", "in", "a:form", 0),
], "route, methods, handler, params, auth"))
def q_endpoints(spark, sf_dir):
    """Endpoints of six frameworks in three languages."""
    sources = made(spark, WEB)
    facts = files.extract_python(sources.where("language = 'python'")).unionByName(braces.extract(sources))
    params = F.array_join(F.array_sort(F.array_distinct(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["source"])))), ",")
    return endpoints.endpoints(facts).select("route", F.array_join("methods", ",").alias("methods"), "handler", params.alias("params"), F.col("auth_required").cast("int").alias("auth"))


CONFIG = {
    "pom.xml": "<project xmlns='http://maven.apache.org/POM/4.0.0'><properties><xstream.version>1.4.9</xstream.version></properties><dependencies><dependency><groupId>com.alibaba</groupId><artifactId>fastjson</artifactId><version>1.2.83</version></dependency><dependency><groupId>com.thoughtworks.xstream</groupId><artifactId>xstream</artifactId><version>${xstream.version}</version></dependency></dependencies></project>",
    "application.yml": "management:\n  endpoints:\n    web:\n      exposure:\n        include: '*'\nspring:\n  security:\n    enabled: true\n", "application.properties": "# note\nspring.devtools.restart.enabled = true\nserver.port: 8080\n",
    "web.xml": "<web-app><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/x/*</url-pattern></servlet-mapping><security-constraint><web-resource-collection><url-pattern>/admin/*</url-pattern></web-resource-collection></security-constraint></web-app>",
}


@query("SELECT * FROM " + _values([("pom.xml", "com.thoughtworks.xstream:xstream", "1.4.9"), ("application.yml", "management.endpoints.web.exposure.include", "*"), ("application.properties", "spring.devtools.restart.enabled", "true")], "path, key, value"))
def q_java_config(spark, sf_dir):
    """Dependencies below a fixed version and settings with a dangerous value."""
    found = configuration.extract(made(spark, CONFIG).select("path", "content"))
    return configuration.vulnerable(found).select("path", F.col("library").alias("key"), F.col("version").alias("value")).unionByName(configuration.dangerous(found).select("path", "key", "value"))


@query("SELECT * FROM " + _values([("servlet-mapping", "s", "/x/*"), ("secured", "url-pattern", "/admin/*")], "kind, key, value"))
def q_web_descriptor(spark, sf_dir):
    return configuration.extract(made(spark, CONFIG).select("path", "content")).where("path = 'web.xml'").select("kind", "key", "value")
