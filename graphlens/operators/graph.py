"""Graph search as level joins, and control-flow algebra by function."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.store import Tables


def bfs(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None, max_hops: int, reverse: bool = False, edge_types: tuple[str, ...] | None = None, keep_path: bool = False) -> DataFrame:
    """(source, node, hops[, path]): nodes that each seed reaches, at their least distance.

    ``edges`` (src, dst[, edge_type]), ``seeds`` and ``targets`` (node_id). All sources
    advance together: a level is one join on the edge's start and one anti-join with what
    the source has seen. Targets are terminal: they are not expanded, and a seed is no
    target of its own. With ``targets`` only hits are returned. Equal paths: the least one.
    Each level is stored, so the plan is as long for twenty hops as for one, and the search
    ends with the first level that finds nothing new.
    """
    store = Tables(edges.sparkSession, "bfs")
    steps = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = steps.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    if targets is not None:
        steps = steps.join(targets.select(F.col("node_id").alias("node")).distinct().withColumn("stop", F.lit(True)), "node", "left")
    steps = store(steps)
    start = seeds.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0).alias("hops")).distinct()
    frontier = store(start.withColumn("path", F.array("node")) if keep_path else start)
    seen = frontier
    for hop in range(1, max_hops + 1):
        onward = frontier.join(steps, "node")
        if targets is not None:
            onward = onward.where(F.col("stop").isNull() | (F.col("node") == F.col("source")))
        rows = onward.select("source", F.col("next").alias("node"), F.lit(hop).alias("hops"), *([F.concat("path", F.array("next")).alias("path")] if keep_path else []))
        rows = rows.groupBy("source", "node", "hops").agg(F.min("path").alias("path")) if keep_path else rows.distinct()
        frontier = store(rows.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = store(seen)
    out = seen if targets is None else seen.where("hops > 0").join(targets.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    return store.done(out.select("source", "node", "hops", *(["path"] if keep_path else [])))


def reach(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, round): the closure of ``seeds`` (node) over ``edges`` (src, dst), with the round
    in which each node came; with ``rounds`` only what comes by then. Each round is written, so
    its lineage is short and survives lost executors; so are from time to time those so far."""
    store = Tables(edges.sparkSession, "reach")
    edges = store(edges.select("src", "dst").distinct())
    frontier = store(seeds.select("node", F.lit(0).alias("round")).distinct())
    seen = frontier
    for k in count(1) if rounds is None else range(1, rounds + 1):
        frontier = store(
            frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("round")).distinct().join(seen.select("node"), "node", "left_anti")
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % 16 == 0:
            seen = store(seen)
    return store.done(seen)


def _sets(blocks: list, before: dict) -> dict:
    """Dominators by fixpoint: a block and what dominates all its predecessors."""
    every = set(blocks)
    dom = {x: (every if before.get(x) else {x}) for x in blocks}
    changed = True
    while changed:
        changed = False
        for x in blocks:
            if before.get(x):
                new = {x} | set.intersection(*(dom[p] for p in before[x]))
                changed |= new != dom[x]
                dom[x] = new
    return dom


def control_flow(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(func, relation, a, b): a dominates b, immediately or not, post-dominates b, or b hangs on a's branch.

    ``blocks`` (func, block) and ``edges`` (func, src, dst). A function's blocks are one
    group; functions are small, their number is what grows.
    """
    rows = blocks.select("func", F.col("block").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select("func", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    out = pa.schema([("func", pa.int64()), ("relation", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def one(group: pa.Table) -> pa.Table:
        func = group.column("func")[0].as_py()
        pairs = list(zip(group.column("a").to_pylist(), group.column("b").to_pylist(), strict=True))
        order = sorted(a for a, b in pairs if b is None)
        before: dict = {x: [] for x in order}
        after: dict = {x: [] for x in order}
        for a, b in pairs:
            if b is not None:
                before[b].append(a)
                after[a].append(b)
        dom = _sets(order, before)
        end = object()  # a virtual exit joins all blocks that lead nowhere
        behind = {x: (after[x] or [end]) for x in order}
        post = _sets([end, *order], behind)
        found = [("dominates", a, b) for b in order for a in dom[b]]
        found += [("post_dominates", a, b) for b in order for a in post[b] if a is not end]
        for b in order:  # the nearest of the others that dominate it has the most dominators itself
            above = sorted((len(dom[a]), a) for a in dom[b] if a != b)
            if above and (len(above) < 2 or above[-1][0] > above[-2][0]):
                found.append(("immediate", above[-1][1], b))
        for a in order:
            if len(after[a]) > 1:
                depends = {x for s in after[a] for x in post[s] if x is not end and (x == a or x not in post[a])}
                found += [("controls", a, b) for b in depends]
        return pa.Table.from_arrays([pa.array([func] * len(found)), *(pa.array([f[i] for f in found]) for i in range(3))], schema=out)

    return rows.groupBy("func").applyInArrow(one, "func long, relation string, a long, b long")


def neighbours(edges: DataFrame, of: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, neighbour): callees of ``of`` (node), or callers."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.join(of, edges[a] == of["node"]).select("node", F.col(b).alias("neighbour")).distinct()


def taint_paths(edges: DataFrame, nodes: DataFrame, max_nodes: int = 20) -> DataFrame:
    """(source, node, hops): from each labelled source to each labelled sink."""
    return bfs(edges, nodes.where("source").select("node_id"), nodes.where("sink").select("node_id"), max_nodes - 1)


def matching(nodes: DataFrame, pattern: str, exclude: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """The first ``limit`` nodes by id with the pattern in any of their texts; none for an empty one."""
    if not pattern:
        return nodes.limit(0)
    texts = [c for c, kind in nodes.dtypes if kind == "string"]
    hit = F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in texts]), lambda x: x.contains(pattern))
    return nodes.where(hit & ~F.coalesce(F.col("node_type"), F.lit("")).isin(*exclude)).orderBy("node_id").limit(limit)


FLOW_EDGES = ("DATA_FLOW", "CALLS")


def find_path(edges: DataFrame, nodes: DataFrame, source_pattern: str, sink_pattern: str, max_nodes: int = 20, max_paths: int = 20) -> DataFrame:
    """(source, node, hops, path) from nodes with one pattern to those with the other, shortest
    first; functions themselves are no ends. ``max_nodes`` counts the nodes of a path."""
    ends = [matching(nodes, p, ("function",)).select("node_id") for p in (source_pattern, sink_pattern)]
    return bfs(edges, *ends, max_nodes - 1, edge_types=FLOW_EDGES, keep_path=True).orderBy("hops", "source", "node").limit(max_paths)


def find_sources(edges: DataFrame, nodes: DataFrame, sink_pattern: str, max_hops: int = 15) -> DataFrame:
    """The assignments and labelled nodes from which a matching node can be reached, and such matches."""
    found = bfs(edges, matching(nodes, sink_pattern).select("node_id"), None, max_hops, reverse=True, edge_types=FLOW_EDGES)
    near = found.groupBy(F.col("node").alias("node_id")).agg(F.min("hops").alias("hops"))
    return nodes.join(near, "node_id").where((F.col("node_type") == "assignment") | F.col("taint").isNotNull())


def find_sinks(edges: DataFrame, nodes: DataFrame, source_pattern: str, max_hops: int = 15) -> DataFrame:
    """The labelled nodes that a matching node reaches."""
    found = bfs(edges, matching(nodes, source_pattern).select("node_id"), None, max_hops, edge_types=FLOW_EDGES)
    near = found.groupBy(F.col("node").alias("node_id")).agg(F.min("hops").alias("hops"))
    return nodes.join(near, "node_id").where(F.col("taint").isNotNull())


def call_chain(edges: DataFrame, nodes: DataFrame, first: str, last: str, max_nodes: int = 20) -> DataFrame:
    """The shortest path of calls between two functions by name: one row at most."""
    named = lambda name: nodes.where((F.col("node_type") == "function") & (F.col("name") == name)).select("node_id")
    return bfs(edges, named(first), named(last), max_nodes - 1, edge_types=("CALLS",), keep_path=True).orderBy("hops", "source", "node").limit(1)


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that a flow or call edge joins."""
    return pairs.join(edges.where(F.col("edge_type").isin(*FLOW_EDGES)).select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def reverse_sinks(edges: DataFrame, nodes: DataFrame, sinks: DataFrame, covered: DataFrame, max_hops: int = 15) -> DataFrame:
    """(sink, node, hops): the source-like nodes behind each of ``sinks`` (node_id) that no path covers
    yet; the search stops at the first such node of a branch. ``nodes`` has source_like (boolean)."""
    open_ = sinks.join(covered, "node_id", "left_anti")
    likely = nodes.where("source_like").select("node_id")
    found = bfs(edges, open_, likely, max_hops, reverse=True, edge_types=FLOW_EDGES)
    return found.select(F.col("source").alias("sink"), "node", "hops")


def saturate(calls: DataFrame, confirmed: DataFrame, max_rounds: int = 4) -> DataFrame:
    """(node, round): callers and callees of the ``confirmed`` functions (node), round by round until
    nothing new comes or ``max_rounds`` are over."""
    both = calls.select("src", "dst").unionByName(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, confirmed, max_rounds)


def branching(edges: DataFrame) -> DataFrame:
    """(func, block, ways): blocks with two or more different successors."""
    return edges.select("func", "src", "dst").distinct().groupBy("func", F.col("src").alias("block")).agg(F.count("*").alias("ways")).where("ways >= 2")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` as (keys, first)."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"))


def latest(rows: DataFrame, key: str, order: list, keep: int = 1) -> DataFrame:
    """The newest ``keep`` rows of each key. Spark limits each group before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= keep)


def python_rows(files: DataFrame, extract, schema: str, fields: list) -> DataFrame:
    """Rows that ``extract(path, content)`` makes of each file, in Arrow batches."""
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in extract(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(out)], schema=out)

    return files.select("path", "content").mapInArrow(run, schema)
