"""Operators on small made graphs, sources and texts."""

import random

from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.operators import graph, retrieval, rules
from graphlens.sources import files
from graphlens.streaming import streams


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_targets_are_terminal_and_ties_take_the_least_path(spark):
    e = edges_of(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "b"), ("e", "a")])
    found = graph.bfs(e, ids(spark, ["a"]), ids(spark, ["d", "e", "a"]), 5, keep_path=True).collect()
    assert [(r["node"], r["hops"], r["path"]) for r in found] == [("d", 2, ["a", "b", "d"])]


def test_bfs_random(spark):
    rng = random.Random(1)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(60)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    expected = set()
    for s in ("0", "1", "2"):
        seen, level = {s: 0}, [s]
        for hop in range(1, 4):
            level = {y for x in level for y in after.get(x, ()) if y not in seen}
            seen |= dict.fromkeys(level, hop)
        expected |= {(s, n, h) for n, h in seen.items()}
    found = graph.bfs(edges_of(spark, pairs), ids(spark, ["0", "1", "2"]), None, 3).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_control_flow_random(spark):
    rng = random.Random(2)
    blocks, pairs = [], []
    for f in range(25):
        n = rng.randrange(2, 8)
        blocks += [(f, b) for b in range(n)]
        pairs += [(f, i, i + 1) for i in range(n - 1)] + [(f, rng.randrange(n), rng.randrange(1, n)) for _ in range(3)]
    found = {(r["func"], r["relation"], r["a"], r["b"]) for r in graph.control_flow(spark.createDataFrame(blocks, "func long, block long"), spark.createDataFrame(pairs, "func long, src long, dst long")).collect()}
    for f in range(25):
        own = [b for g, b in blocks if g == f]
        after = {b: {d for g, s, d in pairs if g == f and s == b} for b in own}

        def reached(start, without):
            seen, todo = set(), [] if start == without else [start]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in after[x] if y != without]
            return seen

        for a in own:
            kept = reached(0, a)
            assert {b for b in own if b not in kept} == {b for g, r, x, b in found if (g, r, x) == (f, "dominates", a)}


def test_closure_rounds(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(3, 0)], "src long, dst long")
    found = graph.reach(e, spark.createDataFrame([(2,)], "node long")).collect()
    assert {(r["node"], r["round"]) for r in found} == {(2, 0), (3, 1), (0, 2), (4, 2), (1, 3), (5, 3), (6, 4)}


def test_front_end(spark):
    source = "import os\nfrom a.b import c as d\nclass K(Base):\n    def m(self, x):\n        y = x + 1\n        return helper(y)\n\ndef helper(z):\n    return z\n\n@app.route('/r', methods=['POST'])\ndef view():\n    return helper(1)\n"
    rows = spark.createDataFrame([("k.py", "python", source), ("bad.py", "python", "def ("), ("none.py", "python", None)], "path string, language string, content string")
    facts = files.extract_python(rows).cache()
    got = {(r["kind"], r["name"], r["owner"], r["detail"]) for r in facts.where("path = 'k.py'").collect()}
    assert {("function", "m", "K", "self,x"), ("class", "K", "", "Base"), ("import", "a.b", "", "c"), ("route", "/r", "view", "POST"), ("call", "helper", "K.m", "helper(y)")} <= got
    assert facts.where("kind = 'error'").count() == 1
    uses = {(r["owner"], r["name"]): r["uses"] for r in files.def_use(facts).collect()}
    assert uses["K.m", "y"] == [6] and uses["K.m", "x"] == [5]
    assert {(r["caller"], r["target"]) for r in files.call_edges(facts).where("callee = 'helper'").collect()} == {("K.m", "k.py"), ("view", "k.py")}


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1")
    (tmp_path / "a" / "y.java").write_text("class Y {}")
    (tmp_path / "z.txt").write_text("no")
    tree = files.read_tree(spark, str(tmp_path))
    assert sorted(r["language"] for r in tree.collect()) == ["java", "python"] and files.project_language(tree).first()[0] == "python"


def test_rules(spark):
    lines = spark.createDataFrame([(1, "d", "en", 1, "Password = x"), (1, "d", "en", 2, "# password = x"), (1, "d", "xx", 3, "Licensed under"), (2, "d", "en", 1, "CALL(1)"), (2, "d", "en", 2, None)], "file long, dir string, language string, line_no long, line string")
    assert {(r["file"], r["line_no"], r["rule_id"]) for r in rules.scan_lines(lines).collect()} == {(1, 1, "CRED-1"), (2, 1, "BAD-1")}
    assert not rules.is_regex("call(") and rules.find_nodes(lines, "", ["line"]).count() == 0


def test_tightest_range(spark):
    points = spark.createDataFrame([(1, 5), (1, 200), (2, 5)], "file long, line_no long")
    ranges = spark.createDataFrame([(1, 1, 300, "module"), (1, 4, 6, "f"), (1, 4, 60, "g"), (3, 1, 9, "h")], "file long, lo long, hi long, name string")
    assert {(r["file"], r["line_no"], r["name"]) for r in retrieval.tightest(points, ranges).collect()} == {(1, 5, "f"), (1, 200, "module")}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert round(value(S.bayes(S.bayes(F.lit(0.5), F.lit(0.95), F.lit(0.10)), F.lit(0.10), F.lit(0.85))), 6) == 0.527778
    assert value(S.chao(F.lit(1), F.lit(4))) == 0.875 and value(S.chao(F.lit(3), F.lit(2))) == 0.0
    assert value(S.endpoint_score(F.lit("GET"), F.lit(0), F.lit(False), F.lit("/test"))) == 2
    assert value(S.version_below(F.lit("1.2"), F.lit("1.2.1"))) and value(S.version_below(F.lit("x"), F.lit("1"))) and not value(S.version_below(F.lit("1.10"), F.lit("1.9")))
    assert value(S.parse_line(F.lit("a:b:12"))) == 12 and value(S.parse_line(F.lit("a"))) is None
    assert value(S.merge_routes(F.lit("api/"), F.lit("/x"))) == "/api/x" and value(S.word_in(F.lit("a b_c"), F.lit("b"))) is False


def test_scorer(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "key long, text string")
    assert {r["key"] for r in streams.score(rows).collect()} == {1, 2}


def test_reach_goes_to_its_fixpoint(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long").coalesce(1)
    found = graph.reach(e, spark.createDataFrame([(0,)], "node long")).collect()
    assert {r["node"]: r["round"] for r in found} == {k: k for k in range(71)}
    assert len(graph.reach(e, spark.createDataFrame([(0,)], "node long"), 3).collect()) == 4
