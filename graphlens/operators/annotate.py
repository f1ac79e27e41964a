"""Labels of taint paths: sanitizers on them, whether these always run, and what no path covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import scalars as S

# What cleans a value, where no rules are given; words and markers of likely sinks and sources.
SANITIZERS = ("int(", "float(", "str(", "escape(", "sanitize", "filter", "validate")
KEYWORDS = (
    "sql", "exec", "system", "cmd", "eval", "query", "execute", "read", "write", "open", "process", "run", "popen", "pipeline", "load", "dump", "parse",
    "decode", "deseriali", "render", "template", "redirect", "include", "require", "send", "fetch", "request", "connect", "socket",
)
DANGER = ("execute", "query", "eval", "exec", "system", "popen", "read", "write", "open(", "process", "send", "load", "dump", "parse", "redirect", "render", "run(")
SOURCES = (
    "request", "params", "query", "body", "input", "get_arg", "get_param", "form", "cookie", "header", "session", "argv", "stdin", "environ", "post", "get", "files",
    "readline", "get_json", "get_data", "get_query", "inputstream", "reader", "readutf", "args", "kwargs", "payload", "upload",
)
MODULES = (
    ("os.", 25), ("subprocess.", 25), ("shlex.", 15), ("pickle.", 25), ("marshal.", 20), ("yaml.", 15), ("eval", 30), ("exec", 30), ("Runtime.", 25), ("ProcessBuilder", 25),
    ("ScriptEngine", 20), ("ObjectInputStream", 20), ("XMLReader", 15), ("SAXParser", 15), ("DOMParser", 15), ("vm.", 20),
)


def _any(text, words):
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def candidates(nodes: DataFrame) -> DataFrame:
    """Assignments whose expression calls something, labelled ones first in their file."""
    return nodes.where("node_type = 'assignment' and source like '%(%'").orderBy(F.col("taint").isNull(), "file", "line")


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'assignment' and taint is not null")


def unlabelled_dangerous(nodes: DataFrame) -> DataFrame:
    """Calls in assignments without a label that hold a marker of danger."""
    return nodes.where("node_type = 'assignment' and taint is null and source like '%(%'").where(_any(F.lower("source"), DANGER))


def source_like(nodes: DataFrame):
    """Whether a node looks like input: an unlabelled parameter, or a hint in its name or text."""
    text = F.lower(F.concat_ws(" ", "name", "source"))
    return F.col("taint").isNull() & ((F.col("node_type") == "parameter") | _any(text, SOURCES))


def danger_score(text, reachable, listed):
    """0 to 100: joined strings 20, keywords 8 each up to 30, the first module's weight, 25 if input
    reaches it, 15 if a rule names it. From 40 on it is a likely sink."""
    low = F.lower(text)
    words = F.size(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda w: low.contains(w)))
    weight = None
    for name, w in MODULES:
        weight = F.when(text.contains(name), w) if weight is None else weight.when(text.contains(name), w)
    score = F.when(text.rlike(r"['\"]\s*\+|\+\s*['\"]|%s|\{\w*\}|\.format\("), 20).otherwise(0) + F.least(F.lit(30), 8 * words) + weight.otherwise(0)
    return S.clamp(score + F.when(reachable, 25).otherwise(0) + F.when(listed, 15).otherwise(0), 0, 100).cast("int")


def keywords_in(text):
    return F.array_sort(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda w: F.lower(text).contains(w)))


def sanitizers_on(paths: DataFrame, nodes: DataFrame, patterns: tuple[str, ...] = SANITIZERS) -> DataFrame:
    """(path_id, position, node_id, pattern): path nodes whose text holds a cleaning call. ``paths``
    (path_id, node_ids)."""
    steps = paths.select("path_id", F.posexplode("node_ids").alias("position", "node_id"))
    met = steps.join(nodes.select("node_id", F.lower("source").alias("text")), "node_id")
    hits = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.col("text").contains(p))
    return met.select("path_id", "position", "node_id", F.explode(hits).alias("pattern"))


def block_of(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node_id, block): the tightest block of the same file and function around a node's line, the first of equals."""
    inner = blocks.select("file", "function", F.col("node_id").alias("block"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    met = nodes.select("node_id", "file", "function", "line").join(inner, ["file", "function"]).where("line between lo and hi")
    return met.groupBy("node_id").agg(F.min(F.struct(F.expr("hi - lo"), "lo", "block")).alias("b")).select("node_id", "b.block")


def sanitizer_status(found: DataFrame, placed: DataFrame, control: DataFrame, reachable: DataFrame) -> DataFrame:
    """(path_id, status): conditional if a cleaning block hangs on a branch, dead_code if none runs,
    unknown without a block, else must_execute; the first that decides along the path. ``control``
    (block) are the blocks under a branch, ``reachable`` (block) those that run."""
    met = found.join(placed, "node_id", "left").join(control.distinct().withColumn("branched", F.lit(True)), "block", "left")
    met = met.join(reachable.distinct().withColumn("runs", F.lit(True)), "block", "left")
    state = F.when(F.col("block").isNull(), "unknown").when(F.col("runs").isNull(), "dead_code").when(F.col("branched"), "conditional").otherwise("must_execute")
    decisive = F.when(F.col("state") == "unknown", 1).otherwise(0)
    return met.withColumn("state", state).groupBy("path_id").agg(F.min_by("state", F.struct(decisive, "position")).alias("status"))


def labels(paths: DataFrame, status: DataFrame) -> DataFrame:
    """(path_id, label): confirmed without a cleaning call, sanitized if one always runs, else conditional."""
    met = paths.select("path_id").join(status, "path_id", "left")
    return met.select("path_id", F.when(F.col("status").isNull(), "confirmed").when(F.col("status") == "must_execute", "sanitized").otherwise("conditional").alias("label"))


def path_text(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, text): a path as an indented list of places."""
    steps = paths.select("path_id", F.posexplode("node_ids").alias("position", "node_id")).join(nodes.select("node_id", "file", "line", "source"), "node_id")
    line = F.concat(F.when(F.col("position") == 0, "").otherwise("└─ "), F.concat_ws(":", "file", "line"), F.lit(" "), F.col("source"))
    rows = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("r"))
    return rows.select("path_id", F.array_join(F.transform("r", lambda x: F.concat(F.repeat(F.lit("  "), x["position"]), x["l"])), "\n").alias("text"))


def validate_l1(hypotheses: DataFrame, source_kinds: DataFrame, sink_kinds: DataFrame) -> DataFrame:
    """(id, verdict, confidence, issues): a hypothesis (id, kind, confidence) against the types that the rules
    see in its source (id, kinds) and sink (id, kind). Two contradictions reject, one leaves it open."""
    met = hypotheses.join(source_kinds.select("id", F.col("kinds").alias("src")), "id", "left").join(sink_kinds.select("id", F.col("kind").alias("snk")), "id", "left")
    wrong_source = F.coalesce((F.size("src") > 0) & ~F.array_contains("src", F.col("kind")), F.lit(False))
    wrong_sink = F.coalesce(F.col("snk") != F.col("kind"), F.lit(False))
    issues = wrong_source.cast("int") + wrong_sink.cast("int")
    by = F.when(issues == 2, 0.3).when(issues == 1, 0.7).otherwise(1.1)
    return met.select(
        "id", F.when(issues == 2, "rejected").when(issues == 1, "inconclusive").otherwise("confirmed").alias("verdict"),
        F.least(F.lit(1.0), F.col("confidence") * by).alias("confidence"), issues.alias("issues"),
    )


def coverage_gaps(endpoints: DataFrame, covered: DataFrame, label_counts: DataFrame) -> DataFrame:
    """(kind, place, severity): endpoints (endpoint, file) in no covered file (file), and labels that occur
    too often (label, n)."""
    limits = F.when(F.col("label") == "heuristic_sink", 5).when(F.col("label") == "exposed_no_source", 3).when(F.col("label") == "uncovered_sink", 1)
    open_ = endpoints.join(covered.select("file").distinct(), "file", "left_anti").select(F.lit("endpoint").alias("kind"), F.col("endpoint").alias("place"), F.lit("medium").alias("severity"))
    return open_.unionByName(label_counts.where(F.col("n") >= limits).select(F.lit("label").alias("kind"), F.col("label").alias("place"), F.lit("high").alias("severity")))
