"""Shared storage, lineage cuts and small expression helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper- and lower-case ASCII letters, for case folding that leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and everything
    runs in one process (``local`` masters, as in tests) a temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(context, "_graphlens_root"):
        context._graphlens_root = tempfile.mkdtemp(prefix="graphlens-")
    return context._graphlens_root


#: Bytes of rows that a Python worker takes at once while tables are written. Spark's default of 64 MB stands in the
#: executor several times: as vectors that double, as a batch and as Python's objects, for each core.
BATCH_BYTES = 8 << 20


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no lineage.

    The folder goes when the driver ends; ``drop`` removes a table earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/graphlens/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone when the driver ends
            return

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key, None)
        conf.set(key, f"{BATCH_BYTES}b")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.unset(key) if before is None else conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the one table that stays: all others go."""
        made = Scratch(self.spark, "kept")
        out = made.table(df, name)
        self._remove(self.root)
        self.tidy()
        return out

    def tidy(self) -> None:
        """Have shuffle files of ended jobs removed: Spark does so once the driver has no
        reference to them, which may otherwise be much later."""
        gc.collect()
        self.spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Map rows in Arrow batches: ``make()`` runs once in a task and gives a
    function from the input columns (lists) to the output columns (lists)."""
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            columns = step([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of the maps that tell a scan which ids are wanted: 16 bits an id between these, so at most 8 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids (one long column, stored). Made in the tasks; what
    reaches the driver is bounded, and ids beyond the bound let more pass by chance."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits, dtype=bool)
        for batch in batches:
            mask[_bit(batch.column(0).to_numpy(), bits)] = True
        words = np.packbits(mask, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["w", "bits"])

    words = np.zeros(bits // 64, dtype=np.int64)
    for at, found in ids.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[at] = found
    return words.view(np.uint8)


def in_bitmap(mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = _bit(ids, 8 * len(mask))
    return (mask[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


#: Keys that a broadcast takes; more go by a shuffle of the rows that may have one.
BROADCAST_KEYS = 200_000


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Hash of id and text: verdicts that hang on the text go by it, so rows of equal id and
    different texts, and rows without an id, have their own."""
    return F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("\0")), F.coalesce(F.col(text_column), F.lit("\0")))


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` less those whose ``key`` (long) is in ``gone`` (a stored table of one long column).

    Few keys are broadcast. Of many, a bitmap goes to the scan: rows outside it stay where they
    are, the others are shuffled, so that an ever larger table never moves as a whole.
    """
    name, spark = gone.columns[0], rows.sparkSession
    gone = gone.select(F.col(name).alias("__gone")).distinct()
    keyed = rows.withColumn("__row_key", key)
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return keyed.join(F.broadcast(gone), F.col("__row_key") == F.col("__gone"), "left_anti").select(*rows.columns)
    shared = spark.sparkContext.broadcast(id_bitmap(gone))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, keys.fillna(0).to_numpy().astype(np.int64)))

    marked = keyed.withColumn("__maybe", maybe("__row_key"))
    doubtful = marked.where("__maybe").join(gone, F.col("__row_key") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").select(*rows.columns).unionByName(doubtful.select(*rows.columns))
