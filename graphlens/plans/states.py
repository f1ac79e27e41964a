"""Queries of logs, state, turns and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.operators import graph
from graphlens.plans.registry import query
from graphlens.sources import bridge
from graphlens.streaming import streams

SMALL = "small AS (SELECT event_id, user_id, event_type, value FROM events)"


def _turns(spark, sf_dir):
    return bridge.table(spark, sf_dir, "conversations")


@query(f"WITH {SMALL} SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM small) WHERE rn <= 5")
def q_keep_latest(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "events")
    return graph.latest(rows, "user_id", [F.desc("event_id")], 5).select("user_id", "event_id", "value")


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def q_load_latest(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT user_id, min(ts) AS started, max(ts) AS updated, count(*) AS n FROM events GROUP BY user_id ORDER BY updated DESC, user_id LIMIT 20")
def q_list_sessions(spark, sf_dir):
    sessions = bridge.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count("*").alias("n"))
    return sessions.orderBy(F.desc("updated"), "user_id").limit(20)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn <= 3")
def q_recent_turns(spark, sf_dir):
    return graph.latest(_turns(spark, sf_dir), "conv_id", [F.desc("turn"), "role", "text"], 3).select("conv_id", "turn", "role")


TOKENS = "t AS (SELECT conv_id, turn, role, text, greatest(1, length(text) // 4) AS tokens FROM conversations)"


@query(f"WITH {TOKENS}, w AS (SELECT *, sum(tokens) OVER o AS total, row_number() OVER o AS rn FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, tokens FROM w WHERE total <= 100 OR rn = 1")
def q_token_window(spark, sf_dir):
    """The newest turns that fit the budget; the newest one always stays."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = _turns(spark, sf_dir).withColumn("tokens", S.tokens(F.col("text"))).withColumns({"total": F.sum("tokens").over(w), "rn": F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))})
    return rows.where("total <= 100 or rn = 1").select("conv_id", "turn", "tokens")


@query(f"WITH {TOKENS} SELECT role AS zone, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ROLLUP (role)")
def q_token_zones(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn("tokens", S.tokens(F.col("text"))).rollup(F.col("role").alias("zone")).agg(F.sum("tokens").alias("tokens"))


@query("WITH f AS (SELECT conv_id, turn, regexp_extract(text, '([A-Z][a-z]+)', 1) AS id FROM conversations) SELECT conv_id, id, min(turn) AS turn FROM f WHERE id <> '' GROUP BY ALL")
def q_crystal_extract(spark, sf_dir):
    found = _turns(spark, sf_dir).select("conv_id", "turn", F.regexp_extract("text", "([A-Z][a-z]+)", 1).alias("id")).where("id <> ''")
    return graph.first_seen(found, ["conv_id", "id"], "turn").withColumnRenamed("first", "turn")


@query(f"WITH {TOKENS}, r AS (SELECT conv_id, turn, sum(tokens) OVER w AS total, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, total > 80 OR n >= 5 AS crystallize FROM r")
def q_crystal_trigger(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    total, n = F.sum(S.tokens(F.col("text"))).over(w), F.count("*").over(w)
    return _turns(spark, sf_dir).select("conv_id", "turn", ((total > 80) | (n >= 5)).alias("crystallize"))


CHAIN = "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), c AS (SELECT user_id, seq, sha256(event_id || '|' || event_type || '|') AS hash FROM e WHERE seq = 1 UNION ALL SELECT e.user_id, e.seq, sha256(e.event_id || '|' || e.event_type || '|' || c.hash) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)"


@query(f"{CHAIN} SELECT user_id, max_by(hash, seq) AS head, CAST(max(seq) AS BIGINT) AS n FROM c GROUP BY user_id")
def q_audit_chain(spark, sf_dir):
    return streams.chain(bridge.table(spark, sf_dir, "events")).groupBy("user_id").agg(F.max_by("hash", "seq").alias("head"), F.max("seq").alias("n"))


@query("SELECT user_id, bool_and(event_id % 97 <> 0) AS intact FROM events GROUP BY user_id")
def q_audit_verify(spark, sf_dir):
    """Each entry against its stored predecessor, in parallel, without a fold. Every entry with an id
    divisible by 97 is changed after the chain was made, so its log must not pass."""
    chained = streams.chain(bridge.table(spark, sf_dir, "events"))
    broken = chained.withColumn("entry", F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("x"), "entry")).otherwise(F.col("entry")))
    return streams.verify(broken)


@query("SELECT user_id, event_id, epoch_us(lead_ts) - epoch_us(ts) AS micros FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS lead_ts FROM events) WHERE lead_ts IS NOT NULL")
def q_spans(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    micros = F.unix_micros(F.col("n").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.withColumn("n", nxt).where("n is not null").select("user_id", "event_id", micros.alias("micros"))


@query("SELECT CAST(to_json({'id': doc_id, 'quality': quality}) AS VARCHAR) AS line FROM labels WHERE toxic = 1")
def q_export_jsonl(spark, sf_dir):
    return bridge.table(spark, sf_dir, "labels").where("toxic = 1").select(F.to_json(F.struct(F.col("doc_id").alias("id"), "quality"), {"ignoreNullFields": "false"}).alias("line"))


@query("SELECT lang AS language, count(*) AS n, min(doc_id) AS first_case FROM documents WHERE n_chars BETWEEN 100 AND 2000 GROUP BY lang")
def q_golden_filter(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").where("n_chars between 100 and 2000").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_case"))


@query("SELECT 'rule' AS label, count(*) AS n FROM labels WHERE quality = 0 UNION ALL SELECT 'taint', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'exposed', count(*) FROM pages WHERE page_id % 3 <> 0")
def q_findings_union(spark, sf_dir):
    labels, pages = bridge.table(spark, sf_dir, "labels"), bridge.table(spark, sf_dir, "pages")
    tagged = lambda df, name: df.select(F.lit(name).alias("label"))
    rows = tagged(labels.where("quality = 0"), "rule").unionByName(tagged(labels.where("toxic = 1"), "taint")).unionByName(tagged(pages.where("page_id % 3 <> 0"), "exposed"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_type AS phase, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY event_type")
def q_stream_cost(spark, sf_dir):
    return streams.run_to_table(spark, streams.cost(streams.source(spark, sf_dir, "events")), "stream_cost", "complete").select("phase", "n", F.round("cost", 4).alias("cost"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def q_stream_dedup(spark, sf_dir):
    rows = streams.dedup(streams.source(spark, sf_dir, "events"))
    return streams.run_to_table(spark, rows, "stream_dedup", "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    """Open hours too: of an hour that is updated the last count holds."""
    found = streams.run_to_table(spark, streams.windowed(streams.source(spark, sf_dir, "events")), "stream_windows", "update")
    last = found.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query()
def q_scorer(spark, sf_dir):
    """The pluggable scorer with its deterministic stand-in."""
    return streams.score(bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
