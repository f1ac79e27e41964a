"""Queries over the property graph, the co-purchase graph and dialogues as control flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import graph
from graphlens.plans.registry import query
from graphlens.sources import bridge

SOURCES = "(SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 0)"
EDGES = """edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CALLS' AS kind FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CALLS' FROM customer
UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'CALLS' FROM orders UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'DATA_FLOW' FROM lineitem
UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'DATA_FLOW' FROM lineitem)"""
TAINT = f"""WITH {EDGES}, d AS (SELECT DISTINCT src, dst FROM edges), s AS {SOURCES}, t AS (SELECT 'part:' || p_partkey AS node_id FROM part WHERE p_size >= 48),
h1 AS (SELECT node_id AS source, dst FROM s JOIN d ON src = node_id), h2 AS (SELECT DISTINCT source, d.dst FROM h1 JOIN d ON d.src = h1.dst), h3 AS (SELECT DISTINCT source, d.dst FROM h2 JOIN d ON d.src = h2.dst),
hits AS (SELECT source, dst AS node, 1 AS hops FROM h1 UNION ALL SELECT source, dst, 2 FROM h2 UNION ALL SELECT source, dst, 3 FROM h3),
paths AS (SELECT source, node, min(hops) AS hops FROM hits JOIN t ON node = node_id GROUP BY ALL)"""
PARTS = """co AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_quantity >= 45 AND a.l_partkey <> b.l_partkey)"""
FLOW = """blocks AS (SELECT DISTINCT conv_id AS func, turn AS block FROM conversations),
steps AS (SELECT func, block AS src, block + 1 AS dst, 'fallthrough' AS kind FROM blocks UNION ALL SELECT func, block, block + 2, 'branch_false' FROM blocks WHERE block % 3 = 0),
flow AS (SELECT steps.* FROM steps JOIN blocks ON steps.func = blocks.func AND steps.dst = blocks.block)"""
#: b is reached from an entry, or reaches an exit, without passing a
CUT = f"""WITH RECURSIVE {FLOW}, entry AS (SELECT func, block FROM blocks WHERE NOT EXISTS (SELECT 1 FROM flow WHERE flow.func = blocks.func AND dst = block)),
final AS (SELECT func, block FROM blocks WHERE NOT EXISTS (SELECT 1 FROM flow WHERE flow.func = blocks.func AND src = block)),
down AS (SELECT e.func, a.block AS a, e.block AS b FROM entry e JOIN blocks a ON a.func = e.func AND a.block <> e.block
  UNION SELECT d.func, d.a, f.dst FROM down d JOIN flow f ON f.func = d.func AND f.src = d.b AND f.dst <> d.a),
up AS (SELECT e.func, a.block AS a, e.block AS b FROM final e JOIN blocks a ON a.func = e.func AND a.block <> e.block
  UNION SELECT d.func, d.a, f.src FROM up d JOIN flow f ON f.func = d.func AND f.dst = d.b AND f.src <> d.a),
dom AS (SELECT x.func, x.block AS a, y.block AS b FROM blocks x JOIN blocks y ON x.func = y.func WHERE NOT EXISTS (SELECT 1 FROM down WHERE down.func = x.func AND down.a = x.block AND down.b = y.block)),
post AS (SELECT x.func, x.block AS a, y.block AS b FROM blocks x JOIN blocks y ON x.func = y.func WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.func = x.func AND up.a = x.block AND up.b = y.block))"""
CONTROLS = f"""{CUT}, forks AS (SELECT func, src FROM flow GROUP BY ALL HAVING count(DISTINCT dst) > 1),
controls AS (SELECT DISTINCT f.func, f.src AS a, p.a AS b FROM flow f JOIN forks k ON k.func = f.func AND k.src = f.src JOIN post p ON p.func = f.func AND p.b = f.dst
WHERE p.a = f.src OR NOT EXISTS (SELECT 1 FROM post q WHERE q.func = f.func AND q.a = p.a AND q.b = f.src))"""


def _taint(spark, sf_dir):
    return graph.taint_paths(bridge.edges(spark, sf_dir), bridge.nodes(spark, sf_dir), 4)


def _closure(spark, sf_dir, rounds=None):
    seeds = bridge.table(spark, sf_dir, "part").where("p_size >= 48").select(F.col("p_partkey").alias("node"))
    return graph.reach(bridge.copurchase(spark, sf_dir), seeds, rounds)


@query(f"{TAINT} SELECT source, node, hops FROM paths")
def q_taint_paths_fk(spark, sf_dir):
    return _taint(spark, sf_dir)


@query(f"{TAINT} SELECT hops + 1 AS n_nodes, count(*) AS n FROM paths GROUP BY ALL")
def q_taint_path_lengths(spark, sf_dir):
    return _taint(spark, sf_dir).groupBy((F.col("hops") + 1).alias("n_nodes")).agg(F.count("*").alias("n"))


@query(f"{TAINT}, san AS (SELECT 'orders:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'F'), direct AS (SELECT DISTINCT source, d2.dst AS node FROM h1 JOIN d d2 ON d2.src = h1.dst WHERE h1.source LIKE 'customer:%' AND h1.dst NOT IN (SELECT node_id FROM san)) SELECT p.source, p.node, CASE WHEN x.source IS NULL THEN 'sanitized' ELSE 'conditional' END AS status FROM paths p LEFT JOIN direct x ON x.source = p.source AND x.node = p.node WHERE p.hops = 2")
def q_sanitizer_status(spark, sf_dir):
    """Two-step paths from a customer: sanitized if each order between is a finished one."""
    edges, nodes = bridge.edges(spark, sf_dir), bridge.nodes(spark, sf_dir)
    paths = _taint(spark, sf_dir).where("hops = 2")
    first = nodes.where("source and node_type = 'customer'").select(F.col("node_id").alias("source"))
    step = edges.select("src", "dst").distinct()
    clean = nodes.where("node_type = 'orders' and name = 'F'").select(F.col("node_id").alias("mid"))
    hop = first.join(step, F.col("source") == F.col("src")).select("source", F.col("dst").alias("mid")).join(clean, "mid", "left_anti")
    open_ = hop.join(step, F.col("mid") == F.col("src")).select("source", F.col("dst").alias("node")).distinct().withColumn("open", F.lit(True))
    return paths.join(open_, ["source", "node"], "left").select("source", "node", F.when(F.col("open").isNull(), "sanitized").otherwise("conditional").alias("status"))


@query(f"{TAINT} SELECT CASE hops WHEN 2 THEN 'confirmed' ELSE 'conditional' END AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM paths GROUP BY ALL")
def q_label_pivot(spark, sf_dir):
    counts = _taint(spark, sf_dir).groupBy(F.when(F.col("hops") == 2, "confirmed").otherwise("conditional").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query(f"WITH {EDGES}, d AS (SELECT DISTINCT src, dst FROM edges), s AS (SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0), h1 AS (SELECT DISTINCT dst FROM s JOIN d ON src = node_id), h2 AS (SELECT DISTINCT d.dst FROM h1 JOIN d ON d.src = h1.dst) SELECT node, min(hops) AS hops FROM (SELECT node_id AS node, 0 AS hops FROM s UNION ALL SELECT dst, 1 FROM h1 UNION ALL SELECT dst, 2 FROM h2) GROUP BY node")
def q_bfs_forward(spark, sf_dir):
    seeds = bridge.nodes(spark, sf_dir).where("source and node_type = 'customer'").select("node_id")
    return graph.bfs(bridge.edges(spark, sf_dir), seeds, None, 2).groupBy("node").agg(F.min("hops").alias("hops"))


@query(f"WITH {EDGES}, d AS (SELECT DISTINCT src, dst FROM edges), t AS (SELECT 'part:' || p_partkey AS node_id FROM part WHERE p_size >= 48), h1 AS (SELECT DISTINCT src FROM t JOIN d ON dst = node_id), h2 AS (SELECT DISTINCT d.src FROM h1 JOIN d ON d.dst = h1.src) SELECT node, min(hops) AS hops FROM (SELECT node_id AS node, 0 AS hops FROM t UNION ALL SELECT src, 1 FROM h1 UNION ALL SELECT src, 2 FROM h2) GROUP BY node")
def q_bfs_backward(spark, sf_dir):
    seeds = bridge.nodes(spark, sf_dir).where("sink").select("node_id")
    return graph.bfs(bridge.edges(spark, sf_dir), seeds, None, 2, reverse=True).groupBy("node").agg(F.min("hops").alias("hops"))


WALK = """walk AS (SELECT node_id AS source, dst AS node, 1 AS hops FROM s JOIN co ON src = node_id
  UNION SELECT source, dst, hops + 1 FROM walk JOIN co ON src = node WHERE hops < 19 AND node NOT IN (SELECT node_id FROM t))"""


@query(f"WITH RECURSIVE {PARTS}, s AS (SELECT min(src) AS node_id FROM co), t AS (SELECT -1 AS node_id), {WALK} SELECT node, min(hops) AS hops FROM walk WHERE node <> source GROUP BY node")
def q_call_chain(spark, sf_dir):
    """The lengths of the shortest chains of calls from the first function to each other, of twenty nodes at most."""
    co = bridge.copurchase(spark, sf_dir)
    return graph.bfs(co, co.agg(F.min("src").alias("node_id")), None, 19).where("hops > 0").select("node", F.col("hops").cast("int").alias("hops"))


@query(f"WITH RECURSIVE {PARTS}, s AS (SELECT p_partkey AS node_id FROM part WHERE p_size = 50), t AS (SELECT p_partkey AS node_id FROM part WHERE p_size = 1), {WALK} SELECT source, node, min(hops) AS hops FROM walk WHERE node IN (SELECT node_id FROM t) GROUP BY ALL")
def q_find_path(spark, sf_dir):
    """From each source to the sinks that it reaches, at the full depth of twenty nodes; sinks are not expanded."""
    part = bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_size")
    return graph.bfs(bridge.copurchase(spark, sf_dir), part.where("p_size = 50"), part.where("p_size = 1"), 19)


@query(f"WITH {PARTS} SELECT dst AS node, src AS neighbour FROM co")
def q_callers(spark, sf_dir):
    co = bridge.copurchase(spark, sf_dir)
    return graph.neighbours(co, co.select(F.col("dst").alias("node")).distinct(), reverse=True)


@query(f"WITH {PARTS} SELECT src AS node, dst AS neighbour FROM co")
def q_callees(spark, sf_dir):
    co = bridge.copurchase(spark, sf_dir)
    return graph.neighbours(co, co.select(F.col("src").alias("node")).distinct())


SEEDS = "seeds AS (SELECT p_partkey AS node FROM part WHERE p_size >= 48)"


@query(f"WITH RECURSIVE {PARTS}, {SEEDS}, reach AS (SELECT node FROM seeds UNION SELECT dst FROM reach JOIN co ON src = node) SELECT node FROM reach")
def q_reachable_blocks(spark, sf_dir):
    return _closure(spark, sf_dir).select("node")


@query(f"WITH RECURSIVE {PARTS}, {SEEDS}, levels AS (SELECT node, 0 AS round FROM seeds UNION SELECT dst, round + 1 FROM levels JOIN co ON src = node WHERE round < 4), first AS (SELECT node, min(round) AS round FROM levels GROUP BY node) SELECT round, count(*) AS fresh FROM first GROUP BY round")
def q_saturation(spark, sf_dir):
    """New nodes in each of the four rounds that a saturation scan has."""
    return _closure(spark, sf_dir, 4).groupBy("round").agg(F.count("*").alias("fresh"))


@query(f"WITH {FLOW} SELECT func, src AS block, count(DISTINCT dst) AS ways FROM flow GROUP BY ALL HAVING count(DISTINCT dst) >= 2")
def q_branch_blocks(spark, sf_dir):
    return graph.branching(bridge.blocks(spark, sf_dir)[1])


def _relation(name):
    def run(spark, sf_dir):
        blocks, flow = bridge.blocks(spark, sf_dir)
        return graph.control_flow(blocks, flow).where(F.col("relation") == name).select("func", "a", "b")

    return run


for _name, _relation_name, _sql in (("q_dominators", "dominates", f"{CUT} SELECT func, a, b FROM dom"), ("q_post_dominators", "post_dominates", f"{CUT} SELECT func, a, b FROM post"), ("q_control_dependence", "controls", f"{CONTROLS} SELECT func, a, b FROM controls"),
                                     ("q_immediate_dominators", "immediate", f"{CUT} SELECT x.func, x.a, x.b FROM dom x WHERE x.a <> x.b AND NOT EXISTS (SELECT 1 FROM dom y WHERE y.func = x.func AND y.b = x.b AND y.a <> x.b AND NOT EXISTS (SELECT 1 FROM dom z WHERE z.func = x.func AND z.a = y.a AND z.b = x.a))")):
    _f = _relation(_relation_name)
    _f.__name__ = _name
    query(_sql)(_f)


@query("SELECT a.l_orderkey AS call, a.l_linenumber AS position, b.o_orderpriority AS param, count(*) AS n FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey AND a.l_linenumber = CAST(substr(b.o_orderpriority, 1, 1) AS INTEGER) GROUP BY ALL")
def q_positional_args(spark, sf_dir):
    """Arguments meet parameters of equal position: an equi-join on (call, position)."""
    args = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("position"))
    params = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.substring("o_orderpriority", 1, 1).cast("int").alias("position"), F.col("o_orderpriority").alias("param"))
    return args.join(params, ["call", "position"]).groupBy("call", "position", "param").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT a.l_orderkey AS loc, a.l_partkey AS ref, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def q_rhs_lhs_edges(spark, sf_dir):
    line = bridge.table(spark, sf_dir, "lineitem")
    refs = line.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("loc"), F.col("l_partkey").alias("ref")).distinct()
    targets = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("loc"), F.col("l_partkey").alias("target")).distinct()
    return refs.join(targets, "loc").where("ref <> target")


@query("SELECT DISTINCT d.doc_id, w.word FROM documents d JOIN (VALUES ('password'), ('token'), ('the'), ('de')) w(word) ON regexp_matches(d.text, '(^|[^A-Za-z0-9_$])' || w.word || '([^A-Za-z0-9_$]|$)')")
def q_varref_callsite(spark, sf_dir):
    from graphlens.functions.scalars import word_in

    words = spark.createDataFrame([("password",), ("token",), ("the",), ("de",)], "word string")
    return bridge.table(spark, sf_dir, "documents").join(F.broadcast(words), word_in(F.col("text"), F.col("word"))).select("doc_id", "word").distinct()


@query("SELECT node_type, n FROM (SELECT 'region' AS node_type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def q_nodes_by_type(spark, sf_dir):
    return bridge.nodes(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT kind AS edge_type, count(*) AS n, count(DISTINCT (src, dst)) AS n_distinct FROM edges GROUP BY kind")
def q_edge_multiplicity(spark, sf_dir):
    return bridge.edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("n_distinct"))


@query("SELECT 'part:' || p_partkey AS node_id, p_size FROM part p WHERE p_size >= 48 AND NOT EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey WHERE l_partkey = p_partkey AND c_acctbal < 0)")
def q_reverse_sink(spark, sf_dir):
    """Sinks that no path from a labelled customer reaches."""
    edges, nodes = bridge.edges(spark, sf_dir), bridge.nodes(spark, sf_dir)
    found = graph.bfs(edges, nodes.where("source and node_type = 'customer'").select("node_id"), nodes.where("sink").select("node_id"), 2)
    part = bridge.table(spark, sf_dir, "part").where("p_size >= 48").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), "p_size")
    return part.join(found.select(F.col("node").alias("node_id")).distinct(), "node_id", "left_anti")
