"""Queries of scoring, coverage, cost, convergence and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import scalars as S
from graphlens.plans.registry import query
from graphlens.sources import bridge

CALLS = "calls AS (SELECT event_id AS call_id, ts, user_id AS session, event_type AS phase, value AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"WITH {CALLS} SELECT phase, round(sum(tokens), 4) AS cost, count(*) AS n FROM calls GROUP BY phase")
def q_cost_by_phase(spark, sf_dir):
    return bridge.calls(spark, sf_dir).groupBy("phase").agg(F.round(F.sum("tokens"), 4).alias("cost"), F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT k % 3 AS model, round(sum(tokens), 4) AS cost FROM calls GROUP BY ALL")
def q_cost_by_model(spark, sf_dir):
    return bridge.calls(spark, sf_dir).groupBy((F.col("k") % 3).alias("model")).agg(F.round(F.sum("tokens"), 4).alias("cost"))


@query(f"WITH {CALLS} SELECT phase, model, round(sum(tokens), 4) AS cost, count(*) AS n FROM (SELECT phase, k % 3 AS model, tokens FROM calls) GROUP BY GROUPING SETS ((), (phase), (model))")
def q_cost_grouping_sets(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).withColumn("model", F.col("k") % 3)
    return rows.groupingSets([[], ["phase"], ["model"]], "phase", "model").agg(F.round(F.sum("tokens"), 4).alias("cost"), F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT session, call_id, round(sum(tokens) OVER (PARTITION BY session ORDER BY call_id), 4) AS spent, sum(tokens) OVER (PARTITION BY session ORDER BY call_id) >= 500 AS exceeded FROM calls")
def q_budget_running(spark, sf_dir):
    spent = F.sum("tokens").over(Window.partitionBy("session").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0))
    return bridge.calls(spark, sf_dir).select("session", "call_id", F.round(spent, 4).alias("spent"), (spent >= 500).alias("exceeded"))


@query(f"WITH {CALLS} SELECT phase, " + ", ".join(f"count(*) FILTER (WHERE tokens <= {b}) AS le_{i}" for i, b in enumerate(S.BUCKETS)) + ", count(*) AS inf, round(sum(tokens), 4) AS total FROM calls GROUP BY phase")
def q_latency_histogram(spark, sf_dir):
    cells = [F.count_if(F.col("tokens") <= b).alias(f"le_{i}") for i, b in enumerate(S.BUCKETS)]
    return bridge.calls(spark, sf_dir).groupBy("phase").agg(*cells, F.count("*").alias("inf"), F.round(F.sum("tokens"), 4).alias("total"))


@query(f"WITH {CALLS} SELECT 'calls_total{{phase=\"' || phase || '\",model=\"' || (k % 3) || '\"}} ' || count(*) AS line FROM calls GROUP BY phase, k % 3")
def q_counter_labels(spark, sf_dir):
    counts = bridge.calls(spark, sf_dir).groupBy("phase", (F.col("k") % 3).alias("model")).agg(F.count("*").alias("n"))
    return counts.select(F.format_string('calls_total{phase="%s",model="%d"} %d', "phase", "model", "n").alias("line"))


@query(f"WITH {CALLS} SELECT phase, max_by(tokens, call_id) AS gauge FROM calls GROUP BY phase")
def q_gauge_last(spark, sf_dir):
    return bridge.calls(spark, sf_dir).groupBy("phase").agg(F.max_by("tokens", "call_id").alias("gauge"))


ROUNDS = f"{CALLS}, rounds AS (SELECT dayofmonth(ts) AS round, count(*) FILTER (WHERE phase = 'purchase' AND tokens > 90) AS fresh FROM calls GROUP BY ALL)"


@query(f"WITH {ROUNDS} SELECT round, fresh, sum(fresh) OVER w = 0 AND count(*) OVER w >= 3 AS passed FROM rounds WINDOW w AS (ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def q_vdr_window(spark, sf_dir):
    # rounds are few: the log is aggregated before the one ordered window
    new = F.count_if((F.col("phase") == "purchase") & (F.col("tokens") > 90)).alias("fresh")
    rounds = bridge.calls(spark, sf_dir).groupBy(F.dayofmonth("ts").cast("long").alias("round")).agg(new)
    w = Window.orderBy("round").rowsBetween(-2, 0)
    return rounds.select("round", "fresh", ((F.sum("fresh").over(w) == 0) & (F.count("*").over(w) >= 3)).alias("passed"))


@query(f"WITH {CALLS}, a AS (SELECT DISTINCT session FROM calls WHERE phase = 'click' AND tokens > 60), b AS (SELECT DISTINCT session FROM calls WHERE phase = 'purchase' AND tokens > 60), f AS (SELECT count(*) FILTER (WHERE a.session IS NULL OR b.session IS NULL) AS one, count(*) FILTER (WHERE a.session = b.session) AS two FROM a FULL JOIN b ON a.session = b.session) SELECT one, two, round(CASE WHEN one = 0 AND two = 0 THEN 1.0 WHEN two = 0 THEN 0.0 WHEN one = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - CAST(one AS DOUBLE) * one / (2 * two))) END, 6) AS c_hat FROM f")
def q_chao2(spark, sf_dir):
    seen = bridge.calls(spark, sf_dir).where("tokens > 60").groupBy("session").agg(F.bool_or(F.col("phase") == "click").alias("a"), F.bool_or(F.col("phase") == "purchase").alias("b"))
    f = seen.agg(F.count_if(F.col("a") != F.col("b")).alias("one"), F.count_if(F.col("a") & F.col("b")).alias("two"))
    return f.select("one", "two", F.round(S.chao(F.col("one"), F.col("two")), 6).alias("c_hat"))


@query("SELECT round(count(*) FILTER (WHERE page_id % 3 = 0) * 1.0 / count(*), 3) AS ec, round(sum(CASE WHEN page_id % 3 = 0 THEN length(url) ELSE 0 END) * 1.0 / sum(length(url)), 3) AS rwc, round(count(DISTINCT page_id % 7) / 7.0, 3) AS vcc FROM pages")
def q_ec_rwc_vcc(spark, sf_dir):
    done, risk = F.col("page_id") % 3 == 0, F.length("url")
    return bridge.table(spark, sf_dir, "pages").agg(
        F.round(F.count_if(done) / F.count("*"), 3).alias("ec"), F.round(F.sum(F.when(done, risk).otherwise(0)) / F.sum(risk), 3).alias("rwc"), F.round(F.countDistinct(F.col("page_id") % 7) / 7.0, 3).alias("vcc")
    )


@query(f"WITH {CALLS}, r AS (SELECT dayofmonth(ts) AS round, avg(tokens) AS m, count(DISTINCT phase) AS p FROM calls GROUP BY ALL) SELECT round, CASE WHEN m >= 50 AND p >= 5 THEN 'converged' WHEN round >= 30 THEN 'escalate_to_human' ELSE 'continue' END AS verdict FROM r")
def q_convergence_verdict(spark, sf_dir):
    r = bridge.calls(spark, sf_dir).groupBy(F.dayofmonth("ts").cast("long").alias("round")).agg(F.avg("tokens").alias("m"), F.countDistinct("phase").alias("p"))
    return r.select("round", F.when((F.col("m") >= 50) & (F.col("p") >= 5), "converged").when(F.col("round") >= 30, "escalate_to_human").otherwise("continue").alias("verdict"))


@query(f"WITH {CALLS} SELECT session, k, min(dayofmonth(ts)) AS round FROM calls GROUP BY ALL")
def q_first_seen_round(spark, sf_dir):
    return bridge.calls(spark, sf_dir).groupBy("session", "k").agg(F.min(F.dayofmonth("ts").cast("long")).alias("round"))


@query(f"WITH {CALLS}, seen AS (SELECT DISTINCT session, k FROM calls WHERE dayofmonth(ts) <= 10) SELECT DISTINCT session, k FROM calls WHERE dayofmonth(ts) > 10 AND (session, k) NOT IN (SELECT (session, k) FROM seen)")
def q_cross_round_dedup(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).withColumn("round", F.dayofmonth("ts"))
    return rows.where("round > 10").select("session", "k").distinct().join(rows.where("round <= 10").select("session", "k"), ["session", "k"], "left_anti")


@query(f"WITH {CALLS}, x AS (SELECT k, 'user:' || session AS a, phase AS b FROM calls), p AS (SELECT DISTINCT a || '|' || b AS fingerprint FROM x WHERE k < 50) SELECT fingerprint, count(*) AS n FROM (SELECT a || '|' || b AS fingerprint FROM x WHERE k >= 50) WHERE fingerprint NOT IN (SELECT fingerprint FROM p) GROUP BY ALL")
def q_path_skip(spark, sf_dir):
    rows = bridge.calls(spark, sf_dir).select("k", F.concat_ws("|", F.concat(F.lit("user:"), "session"), "phase").alias("fingerprint"))
    return rows.where("k >= 50").join(rows.where("k < 50").select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT call_id, round(CASE WHEN (tokens / 200) * 0.9 + (1 - tokens / 200) * 0.2 = 0 THEN tokens / 200 ELSE (tokens / 200) * 0.9 / ((tokens / 200) * 0.9 + (1 - tokens / 200) * 0.2) END, 6) AS posterior FROM calls WHERE tokens BETWEEN 0 AND 200")
def q_belief_update(spark, sf_dir):
    prior = F.col("tokens") / 200
    return bridge.calls(spark, sf_dir).where("tokens between 0 and 200").select("call_id", F.round(S.bayes(prior, F.lit(0.9), F.lit(0.2)), 6).alias("posterior"))


@query(f"WITH {CALLS}, w AS (SELECT session, sum(CASE phase WHEN 'purchase' THEN ln(0.6 / 0.4) WHEN 'click' THEN ln(0.45 / 0.55) ELSE 0 END) AS odds FROM calls GROUP BY session) SELECT session, round(1 / (1 + exp(-odds)), 6) AS belief FROM w")
def q_belief_fold(spark, sf_dir):
    """All evidence of a session at once: log odds add up, so no ordered fold is needed."""
    step = F.when(F.col("phase") == "purchase", F.log(F.lit(0.6 / 0.4))).when(F.col("phase") == "click", F.log(F.lit(0.45 / 0.55))).otherwise(0.0)
    return bridge.calls(spark, sf_dir).groupBy("session").agg(F.round(1 / (1 + F.exp(-F.sum(step))), 6).alias("belief"))


@query("WITH s AS (SELECT p_partkey, CAST(least(10, 1 + least(3, p_size // 3) + least(3, p_partkey % 5) + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END + least(2, (p_partkey % 6) // 2)) AS INTEGER) AS complexity FROM part) SELECT p_partkey, complexity, CASE WHEN complexity <= 4 THEN 'cheap' WHEN complexity <= 7 THEN 'mid' ELSE 'strong' END AS tier FROM s")
def q_router_tier(spark, sf_dir):
    k = F.col("p_partkey")
    score = S.complexity(F.col("p_size"), k % 5, k % 7 == 0, k % 11 == 0, k % 6)
    return bridge.table(spark, sf_dir, "part").select("p_partkey", score.alias("complexity"), S.tier(score).alias("tier"))


def _cost(tier: str) -> str:
    _, _, a, b = next(t for t in S.TIERS if t[1] == tier)
    return f"round(p_size * 100 / 1000.0 * {a} + greatest(100.0, floor(p_size * 100 / 5.0)) / 1000 * {b}, 6)"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND {_cost('strong')} <= p_retailprice / 20000 THEN 'strong' WHEN p_partkey % 3 >= 1 AND {_cost('mid')} <= p_retailprice / 20000 THEN 'mid' WHEN {_cost('cheap')} <= p_retailprice / 20000 THEN 'cheap' END AS tier FROM part")
def q_router_budget(spark, sf_dir):
    wanted = F.element_at(F.array(F.lit("cheap"), F.lit("mid"), F.lit("strong")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", S.affordable(wanted, F.col("p_size") * 100, F.col("p_retailprice") / 20000).alias("tier"))


@query("SELECT o_orderkey, abs((o_orderkey % 5) - (o_custkey % 5)) AS distance FROM orders")
def q_eval_severity_distance(spark, sf_dir):
    names = F.array(*map(F.lit, ("info", "low", "medium", "high", "critical")))
    pick = lambda c: F.element_at(names, (F.col(c) % 5 + 1).cast("int"))
    return bridge.table(spark, sf_dir, "orders").select("o_orderkey", S.severity_distance(pick("o_orderkey"), pick("o_custkey")).cast("long").alias("distance"))


@query("SELECT e.event_id, coalesce(x.doc_id, y.doc_id) AS hypothesis, CASE WHEN x.doc_id IS NOT NULL THEN 'exact' WHEN y.doc_id IS NOT NULL THEN 'prefix' END AS matched FROM events e LEFT JOIN (SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL) x ON x.source = 'src' || (e.user_id % 20) AND x.lang = ['en', 'fr', 'it'][e.event_id % 3 + 1] LEFT JOIN (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY ALL) y ON y.source = 'src' || (e.user_id % 20)")
def q_enrich_cascade(spark, sf_dir):
    """Two lookups in order of preference: (source, type), then source alone."""
    docs = bridge.table(spark, sf_dir, "documents")
    exact = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("x"))
    near = docs.groupBy("source").agg(F.min("doc_id").alias("y"))
    keyed = bridge.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("it")), (F.col("event_id") % 3 + 1).cast("int")).alias("lang")
    )
    met = keyed.join(exact, ["source", "lang"], "left").join(near, "source", "left")
    return met.select("event_id", F.coalesce("x", "y").alias("hypothesis"), F.when(F.col("x").isNotNull(), "exact").when(F.col("y").isNotNull(), "prefix").alias("matched"))


@query("WITH known(c) AS (VALUES ('click'), ('purchase'), ('refund'), ('view'), ('login')) SELECT c AS category FROM known WHERE c NOT IN (SELECT event_type FROM events)")
def q_missing_categories(spark, sf_dir):
    known = spark.createDataFrame([("click",), ("purchase",), ("refund",), ("view",), ("login",)], "category string")
    return known.join(bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("category")).distinct(), "category", "left_anti")


@query("SELECT 'auth_missing' AS kind, count(*) AS n FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT 'no_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT 'unsold', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def q_blind_spots(spark, sf_dir):
    t = lambda n: bridge.table(spark, sf_dir, n)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    unlabelled = t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    unsold = t("part").select(F.col("p_partkey").alias("l_partkey")).join(t("lineitem").select("l_partkey"), "l_partkey", "left_anti")
    return count(t("pages").where("page_id % 3 <> 0"), "auth_missing").unionByName(count(unlabelled, "no_label")).unionByName(count(unsold, "unsold"))


@query("SELECT round(coalesce(count(*) FILTER (WHERE l.doc_id IS NOT NULL) * 1.0 / nullif(count(*), 0), 0), 3) AS label_ratio, round(coalesce(count(*) FILTER (WHERE l.quality = 1) * 1.0 / nullif(count(l.doc_id), 0), 0), 3) AS good_ratio FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_coverage_ratios(spark, sf_dir):
    met = bridge.table(spark, sf_dir, "documents").select("doc_id").join(bridge.table(spark, sf_dir, "labels").withColumn("found", F.lit(1)), "doc_id", "left")
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 3)
    return met.agg(ratio(F.count("found"), F.count("*")).alias("label_ratio"), ratio(F.count_if(F.col("quality") == 1), F.count("found")).alias("good_ratio"))


@query("SELECT doc_id, CAST(20 * CAST(contains(text, '+') AS INTEGER) + least(30, 8 * (CAST(contains(lower(text), 'password') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER))) + CASE WHEN contains(text, '@') THEN 25 ELSE 0 END AS BIGINT) AS score FROM documents WHERE text IS NOT NULL")
def q_heuristic_score(spark, sf_dir):
    text = F.col("text")
    words = F.size(F.filter(F.array(*map(F.lit, ("password", "token", "license"))), lambda w: F.lower(text).contains(w)))
    score = F.when(text.contains("+"), 20).otherwise(0) + F.least(F.lit(30), 8 * words) + F.when(text.contains("@"), 25).otherwise(0)
    return bridge.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", score.cast("long").alias("score"))
