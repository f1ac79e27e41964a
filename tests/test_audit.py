"""Sessions, reports, annotation, rules, agents and graph searches on small made rows."""

import json

from pyspark.sql import functions as F

from graphlens.functions import vulnerabilities as V
from graphlens.operators import agents, annotate, graph, report, rules, sessions
from graphlens.sources import braces, endpoints, files, flow

NODES = "node_id string, node_type string, name string, source string, file string, line int, function string, taint string"


def test_sessions_keep_the_latest_row(spark, tmp_path):
    store = sessions.Repository(spark, str(tmp_path))
    assert store.get_session("x").count() == 0 and store.load_latest("x") is None
    key = store.save_session("p", "python")
    other = store.save_session("q", "java")
    store.update_session_status(key, "completed")
    assert store.get_session(key).first()["status"] == "completed" and store.get_session(key).count() == 1
    assert [r["id"] for r in store.list_sessions("running").collect()] == [other] and store.list_sessions().count() == 2
    rows = spark.createDataFrame([("f1", "xss", "high", "t", "a.py", 3, "open", 0.5), ("f2", "ssrf", "low", "t", "b.py", 4, "open", 0.4)], "id string, kind string, severity string, title string, file string, line int, status string, confidence double")
    store.save_findings(key, rows)
    store.update_hypothesis_status("f1", "confirmed", 0.9)
    assert {(r["id"], r["status"], r["confidence"]) for r in store.get_findings(key).collect()} == {("f1", "confirmed", 0.9), ("f2", "open", 0.4)}
    assert store.get_finding_count(key) == 2
    for k in range(4):
        store.save_checkpoint(key, f"phase{k}", {"round": k})
    assert store.load_latest(key)["state"] == {"round": 3} and store.list_checkpoints(key, 2).count() == 2
    assert store.prune(3) == 1 and [r["phase"] for r in store.list_checkpoints(key).collect()] == ["phase1", "phase2", "phase3"]
    state = spark.createDataFrame([('{"phase": "x", "round": 2}',), ("{}",)], "s string").select(sessions.state_from_json(F.col("s")).alias("s")).select("s.*").collect()
    assert (state[0]["phase"], state[0]["round"], state[0]["completed"], state[1]["endpoint_count"]) == ("x", 2, [], 0)
    assert sessions.validate_state({"session": "a", "project": 1}) == ["missing: language", "missing: phase", "not str: project"]


FINDINGS = "rule_id string, severity string, title string, description string, file string, line int, code string, category string, remediation string"


def test_reports(spark, tmp_path):
    rows = [("R-2", "high", "T2", "d", "a.py", 1, "x = 1", "sql_injection", "fix"), ("R-1", "low", "T1", None, "b.py", 2, None, "odd", None), ("R-2", "medium", "T2", "d", "c.py", 0, "", "xss", "fix")]
    found = spark.createDataFrame(rows, FINDINGS)
    order = ["file", "line"]
    for form in ("json", "sarif", "markdown"):
        report.write_report(found, str(tmp_path / form), form, {"project": "p"}, order, F.lit(0))
    doc = json.loads((tmp_path / "sarif").read_text())
    listed = [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]]
    results = doc["runs"][0]["results"]
    assert listed == ["R-2", "R-1"] and all(listed[r["ruleIndex"]] == r["ruleId"] for r in results) and [r["level"] for r in results] == ["error", "note", "warning"]
    place = [r["locations"][0]["physicalLocation"] for r in results]
    assert place[0]["region"]["startLine"] == 1 and place[0]["contextRegion"]["snippet"]["text"] == "x = 1" and "region" not in place[2]
    whole = json.loads((tmp_path / "json").read_text())
    assert whole["total"] == 3 and whole["severity_counts"] == {"high": 1, "low": 1, "medium": 1}
    one = next(f for f in whole["findings"] if f["file"] == "a.py")
    assert one["cvss_score"] == 8.6 and one["cwe_id"] == "CWE-89" and "validation_verdict" not in one
    text = (tmp_path / "markdown").read_text()
    assert text.index("## Injection") < text.index("## Cross-Site") < text.index("## Other") and "### INJ-001 T2" in text
    many = spark.range(1500).select(F.lit("r").alias("g"), "id")
    top = report.numbered(many, "g", ["id"], F.floor(F.col("id") / 100)).select("id", report.padded(F.col("rn")).alias("p")).where("id in (0, 99, 1499)").collect()
    assert {r["id"]: r["p"] for r in top} == {0: "001", 99: "100", 1499: "1500"}


def test_texts_of_findings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(V.duration(F.lit(250))) == "250ms" and value(V.duration(F.lit(1500))) == "1.5s" and value(V.duration(F.lit(125000))) == "2m 5s"
    assert value(V.url_encoded(F.lit("a b'<"))) == "a%20b%27%3C"
    assert value(V.likely_endpoint(F.lit("src/app/user/list.py"), F.lit("sql_injection"))) == "/user/list/search" and value(V.likely_endpoint(F.lit(""), F.lit("x"))) == "/api/endpoint"
    assert value(V.likely_method(F.lit("xxe"), F.lit("x"))) == "POST" and value(V.likely_method(F.lit("x"), F.lit("doDelete(a)"))) == "DELETE"
    assert value(V.variable_names(F.lit("total = price * self.count + fee(x)"))) == ["total", "price", "x"]
    assert value(V.impact(F.lit("xss"))) and value(V.section_rank(F.lit("Other"))) == 11


def test_searches(spark):
    nodes = spark.createDataFrame([
        ("a", "parameter", "q", "q", "f", 1, "v", "src"), ("b", "assignment", "s", "s = clean(q)", "f", 2, "v", None), ("c", "call_site", "run", "run(s)", "f", 3, "v", "sink"),
        ("d", "function", "v", "", "f", 1, "", None), ("e", "function", "w", "", "f", 5, "", None), ("g", "assignment", "u", "u = 1", "f", 6, "w", None),
    ], NODES)
    edges = spark.createDataFrame([("a", "b", "DATA_FLOW"), ("b", "c", "DATA_FLOW"), ("d", "c", "CALLS"), ("c", "e", "CALLS"), ("g", "b", "CTRL_FLOW")], "src string, dst string, edge_type string")
    assert [r["path"] for r in graph.find_path(edges, nodes, "src", "run").collect()] == [["a", "b", "c"]]
    assert {r["node_id"] for r in graph.find_sources(edges, nodes, "run(").collect()} == {"a", "b", "c"}
    assert {r["node_id"] for r in graph.find_sinks(edges, nodes, "clean").collect()} == {"c"}
    assert graph.call_chain(edges, nodes, "v", "w").first()["path"] == ["d", "c", "e"] and graph.call_chain(edges, nodes, "w", "v").count() == 0
    likely = nodes.withColumn("taint", F.lit(None).cast("string"))
    likely = likely.withColumn("source_like", annotate.source_like(likely))
    found = graph.reverse_sinks(edges, likely, nodes.where("node_id = 'c'").select("node_id"), nodes.limit(0).select("node_id")).collect()
    assert [(r["sink"], r["node"], r["hops"]) for r in found] == [("c", "a", 2)]
    assert {(r["node"], r["round"]) for r in graph.saturate(edges, spark.createDataFrame([("c",)], "node string"), 1).collect()} == {("c", 0), ("b", 1), ("d", 1), ("e", 1)}


def test_path_labels(spark):
    nodes, edges = flow.property_graph(spark.createDataFrame([("a.py", "def f(q):\n    if q:\n        q = escape(q)\n    x = int(q)\n    return x\n")], "path string, content string"))
    rows = {(r["line"], r["node_type"]): r["node_id"] for r in nodes.where("node_type in ('assignment', 'call_site')").collect()}
    paths = spark.createDataFrame([(1, [rows[3, "assignment"]]), (2, [rows[4, "assignment"]]), (3, [nodes.where("node_type = 'parameter'").first()["node_id"]])], "path_id long, node_ids array<string>")
    blocks = nodes.where("node_type = 'basic_block'")
    found = annotate.sanitizers_on(paths, nodes)
    control = graph.control_flow(
        blocks.select(F.lit(1).cast("long").alias("func"), F.col("position").cast("long").alias("block")),
        edges.where("edge_type = 'CTRL_FLOW'").select(F.lit(1).cast("long").alias("func"), *(F.element_at(F.split(c, ":"), -1).cast("long").alias(c) for c in ("src", "dst"))),
    ).where("relation = 'controls'").select(F.col("b").alias("position"))
    branched = blocks.join(control.distinct(), "position").select(F.col("node_id").alias("block"))
    placed = annotate.block_of(nodes.where("node_type <> 'basic_block'"), blocks.where("position > 1"))
    status = annotate.sanitizer_status(found, placed, branched, blocks.select(F.col("node_id").alias("block")))
    assert {r["path_id"]: r["label"] for r in annotate.labels(paths, status).collect()} == {1: "conditional", 2: "sanitized", 3: "confirmed"}
    assert "a.py:3" in annotate.path_text(paths, nodes).where("path_id = 1").first()["text"]


def test_rule_files(spark):
    text = "# rules\npython:\n  sql_injection:\n    sources:\n      - request.args\n      - 'input('\n    sinks:\n      - execute(\njava:\n  xss:\n    sinks:\n      - print(\n"
    rows = rules.load_rules(text)
    assert ("python", "sources", "sql_injection", "input(", 1) in rows and len(rows) == 4 and rules.load_rules(json.dumps({"java": {"xss": {"sinks": ["a"]}}})) == [("java", "sinks", "xss", "a", 0)]
    df = spark.createDataFrame(rows + [("cobol", "sinks", "x", "y", 0), ("java", "odd", "x", " ", 0)], "language string, section string, category string, pattern string, ord int")
    assert {r["problem"] for r in rules.rule_problems(df).collect()} == {"language", "section"}
    assert rules.rules_for(df, "python").first()["sources"] == ["request.args", "input("] and [r[0] for r in rules.patterns(df, "python", "sinks").collect()] == ["execute("]
    assert [r[0] for r in rules.languages(df).collect()] == ["cobol", "java", "python"]


def test_agents(spark):
    said = iter([{"hypotheses": []}, {"hypotheses": []}, {"hypotheses": [{"confidence": 0.1}]}, {"hypotheses": [{"confidence": 0.9}]}])
    done = agents.nudge_loop(lambda m, s: next(said), [], {}, (agents.stop_on_empty(), agents.stop_on_low_confidence()))
    assert done.turns == 4 and done.nudges == ["no hypotheses given"] * 2 + ["all below 0.3"]
    assert agents.stop_on_missing_verdict({"verdict": "inconclusive"}) and agents.means_to_continue("Let me look") and not agents.means_to_continue("done")

    class Add:
        name, parameters = "add", {}

        def execute(self, a, b):
            return a + b

    tools = agents.Tools([Add()])
    steps = iter([{"tool": "add", "arguments": {"a": 1, "b": 2}}, {"answer": 3}])
    assert agents.agent_loop(lambda m, s: next(steps), [], {}, tools) == {"answer": 3}
    assert not tools.execute("no").ok and "TypeError" in tools.execute("add", a=1).error
    shown = agents.trimmed([{"role": "tool", "content": str(k)} for k in range(5)], 2)
    assert [m["content"] for m in shown] == ["(left out)"] * 3 + ["3", "4"]

    def fails(messages, schema):
        raise ValueError("no")

    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    assert {r["verdict"] for r in agents.judged(rows, fails).collect()} == {"inconclusive"} and agents.judged(rows).count() == 2
    answers = spark.createDataFrame([(1, json.dumps({"hypotheses": [{"title": "a", "vuln_type": "xss", "source_location": "f:1"}, {"title": "b", "vuln_type": "xss", "source_location": "f:1"}]})), (2, "{}")], "id long, json string")
    assert [(r["title"], r["stable_key"]) for r in agents.hypotheses(answers).collect()] == [("a", "f:1||xss")]


def test_other_languages(spark):
    js = "import a, { b } from './m';\n// function no() {}\nclass K extends L { go(x) { return helper(x); } }\nconst f = async (y) => { const z = \"function s() {\"; g(z); };\nfunction helper(x) { return x; }\n"
    java = "import x.y.Z;\npublic class A extends B implements C {\n  private int n = 0;\n  public String m(String a, int b) throws E { if (a == null) { return run(b); } return a; }\n}\n"
    rows = spark.createDataFrame([("a.js", "javascript", js), ("A.java", "java", java), ("n.js", "javascript", None)], "path string, language string, content string")
    got = {(r["kind"], r["name"], r["owner"], r["detail"]) for r in braces.extract(rows).collect()}
    assert {("class", "K", "", "L"), ("function", "go", "K", "x"), ("function", "f", "", "y"), ("function", "helper", "", "x"), ("call", "helper", "K.go", "helper(x); } }"), ("import", "./m", "", "b")} <= got
    assert {("class", "A", "", "B,C"), ("function", "m", "A", "a,b"), ("parameter", "b", "A.m", "1"), ("import", "x.y", "", "Z")} <= got
    assert not {n for k, n, *_ in got if k == "function"} & {"no", "s", "if"}
    assert {(r["path"], r["framework"]) for r in endpoints.frameworks(spark.createDataFrame([("a.py", "from flask import x")], "path string, content string")).collect()} == {("a.py", "flask")}


def test_guards_and_scores(spark):
    one = spark.createDataFrame([("query('a' + b)", None, "x", "call_site")], "source string, taint string, name string, node_type string")
    row = one.select(annotate.danger_score(F.col("source"), F.lit(True), F.lit(False)).alias("s"), annotate.keywords_in(F.col("source")).alias("k"), annotate.source_like(one).alias("l")).first()
    assert row["s"] == 53 and row["k"] == ["query"] and row["l"]
    gaps = annotate.coverage_gaps(
        spark.createDataFrame([("e", "a"), ("f", "b")], "endpoint string, file string"), spark.createDataFrame([("a",)], "file string"), spark.createDataFrame([("heuristic_sink", 5), ("exposed_no_source", 2)], "label string, n long"))
    assert {(r["kind"], r["place"]) for r in gaps.collect()} == {("endpoint", "f"), ("label", "heuristic_sink")}
    found = files.extract_python(spark.createDataFrame([("a.py", "python", "@requires_auth\ndef f():\n    pass\n")], "path string, language string, content string"))
    assert found.where("kind = 'route_auth'").first()["owner"] == "f"
