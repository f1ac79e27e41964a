"""Views of the relational test tables as lines, graphs, endpoints and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, dir, language, line_no, line), a row for each line of each document."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("dir"), F.col("lang").alias("language"), split).select(
        "file", "dir", "language", (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, node_type, name, source, sink): foreign keys as a property graph."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    row = lambda kind, c, name, source, sink: [key(kind, c).alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), source.alias("source"), sink.alias("sink")]
    no = F.lit(False)
    parts = [
        t("region").select(*row("region", "r_regionkey", F.col("r_name"), no, no)),
        t("nation").select(*row("nation", "n_nationkey", F.col("n_name"), F.col("n_regionkey") == 0, no)),
        t("customer").select(*row("customer", "c_custkey", F.col("c_name"), F.col("c_acctbal") < 0, no)),
        t("orders").select(*row("orders", "o_orderkey", F.col("o_orderstatus"), no, no)),
        t("part").select(*row("part", "p_partkey", F.col("p_name"), no, F.col("p_size") >= 48)),
        t("supplier").select(*row("supplier", "s_suppkey", F.col("s_name"), no, no)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type); parallel edges as they come."""
    t = lambda n: table(spark, sf_dir, n)
    end = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    link = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    line = t("lineitem")
    parts = [
        link(t("nation"), end("region", "n_regionkey"), end("nation", "n_nationkey"), "CALLS"),
        link(t("customer"), end("nation", "c_nationkey"), end("customer", "c_custkey"), "CALLS"),
        link(t("orders"), end("customer", "o_custkey"), end("orders", "o_orderkey"), "CALLS"),
        link(line, end("orders", "l_orderkey"), end("part", "l_partkey"), "DATA_FLOW"),
        link(line, end("part", "l_partkey"), end("supplier", "l_suppkey"), "DATA_FLOW"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that follow each other in an order, from returned large lines. Cyclic."""
    line = table(spark, sf_dir, "lineitem")
    left = line.where("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    right = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return left.join(right, ["l_orderkey", "n"]).where("src <> dst").select("src", "dst").distinct()


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dialogues as control flow: (func, block) and (func, src, dst, kind)."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("func"), F.col("turn").alias("block")).distinct()
    step = lambda k, kind, when: turns.where(when).select("func", F.col("block").alias("src"), (F.col("block") + k).alias("dst"), F.lit(kind).alias("kind"))
    links = step(1, "fallthrough", F.lit(True)).unionByName(step(2, "branch_false", F.col("block") % 3 == 0))
    return turns, links.join(turns.select("func", F.col("block").alias("dst")), ["func", "dst"], "left_semi").select("func", "src", "dst", "kind")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(endpoint_id, route, method, auth_required, n_params, n_links)."""
    route = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("endpoint_id"), route.alias("route"),
        F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (F.col("page_id") % 4 + 1).cast("int")).alias("method"),
        (F.col("page_id") % 3 == 0).alias("auth_required"),
        F.size(F.regexp_extract_all("url", F.lit("[?&]([^=&]*)="), F.lit(1))).alias("n_params"),
        F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n_links"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, ts, session, phase, tokens, k): events as model calls."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("session"), F.col("event_type").alias("phase"), F.col("value").alias("tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
