"""Chunks, inverted index, search and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines that a bucket of a range join holds.
BUCKET = 64


def inverted_index(chunks: DataFrame) -> DataFrame:
    """(term, chunk): the distinct lower-case words of three letters or more."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))), lambda t: F.length(t) >= 3)
    return chunks.select(F.explode(words).alias("term"), "chunk")


def search(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("line").rlike(pattern)).select("file", "line_no", F.regexp_extract("line", pattern, 0).alias("hit"))


def context(lines: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """Lines at most ``width`` from a target (file, line_no, ...): an equi-join on the line
    numbers that a target spans, so that files of any length need no nested loop."""
    spans = targets.withColumn("at", F.explode(F.sequence(F.col("line_no") - width, F.col("line_no") + width)))
    near = lines.select("file", F.col("line_no").alias("at"), "line")
    return spans.join(near, ["file", "at"])


def tightest(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point (file, line_no) with the smallest range (file, lo, hi, ...) around it.

    Ranges are dealt to the buckets of lines that they touch: an equi-join with a residual.
    """
    dealt = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))
    at = points.withColumn("bucket", F.floor(F.col("line_no") / BUCKET))
    met = at.join(dealt, ["file", "bucket"]).where(F.col("line_no").between(F.col("lo"), F.col("hi")))
    w = Window.partitionBy("file", "line_no").orderBy(F.col("hi") - F.col("lo"), "lo")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "bucket")


def similar(chunks: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query, chunk, score): token Jaccard through the inverted index, the ``top`` best."""
    index = inverted_index(chunks)
    sizes = index.groupBy("chunk").agg(F.count("*").alias("n"))
    asked = inverted_index(queries.select(F.col("query").alias("chunk"), "text")).withColumnRenamed("chunk", "query")
    asked_sizes = asked.groupBy("query").agg(F.count("*").alias("m"))
    both = index.join(asked, "term").groupBy("query", "chunk").agg(F.count("*").alias("k"))
    score = F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6)
    scored = both.join(sizes, "chunk").join(F.broadcast(asked_sizes), "query").select("query", "chunk", score.alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")
