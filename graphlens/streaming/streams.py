"""Structured Streaming forms of the log operators, hash chains and the pluggable scorer."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.operators.store import shared_folder


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def cost(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.sum("value").alias("cost"))


def windowed(events: DataFrame) -> DataFrame:
    """Calls by hour; rows later than ten minutes are left out, and finished hours come out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def dedup(events: DataFrame) -> DataFrame:
    """Each event once, with state only as far back as the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(spark: SparkSession, rows: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there now, through a stream into a table in the shared folder. With ``complete`` the last
    batch holds; with ``update`` a column ``batch`` tells which row of a key is the last."""
    root = f"{shared_folder(spark)}/graphlens/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = batch.withColumn("batch", F.lit(number).cast("long")) if mode == "update" else batch
        # a batch that runs again replaces itself
        out.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/part={number}")

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write)
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = rows.schema if mode != "update" else rows.schema.add("batch", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")


def chain(log: DataFrame) -> DataFrame:
    """(user_id, event_id, seq, entry, hash): each entry's hash over its text and the hash before it.

    Rows of a log stand one after another in a sorted partition, and one running hash is kept: a
    log of any length takes no more memory. Logs are independent of each other.
    """
    entry = F.concat_ws("|", "event_id", "event_type", F.lit(""))
    ordered = log.select("user_id", "event_id", entry.alias("entry")).repartition("user_id").sortWithinPartitions("user_id", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last, seq = object(), "", 0
        for batch in batches:
            hashes, places = [], []
            for key, text in zip(batch["user_id"], batch["entry"], strict=True):
                if key != user:
                    user, last, seq = key, "", 0
                last, seq = hashlib.sha256((text + last).encode()).hexdigest(), seq + 1
                hashes.append(last)
                places.append(seq)
            yield batch.assign(seq=places, hash=hashes)[["user_id", "event_id", "seq", "entry", "hash"]]

    return ordered.mapInPandas(run, "user_id long, event_id long, seq long, entry string, hash string")


def verify(chained: DataFrame) -> DataFrame:
    """(user_id, intact): whether each entry's hash is that of its text and the hash before it."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("user_id").orderBy("seq")), F.lit(""))
    return chained.withColumn("ok", F.sha2(F.concat("entry", before), 256) == F.col("hash")).groupBy("user_id").agg(F.bool_and("ok").alias("intact"))


def stand_in(text: str | None) -> tuple[str, float]:
    """A verdict that depends on the text alone, in place of a model."""
    value = zlib.crc32((text or "").encode()) % 1000 / 1000
    return ("confirmed" if value >= 0.5 else "inconclusive" if value >= 0.2 else "rejected"), value


def score(rows: DataFrame, judge: Callable[[str | None], tuple[str, float]] = stand_in) -> DataFrame:
    """(key, verdict, confidence) of each row (key, text) by a pluggable judge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [judge(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "verdict": [f[0] for f in found], "confidence": [f[1] for f in found]})

    return rows.mapInPandas(run, "key long, verdict string, confidence double")
