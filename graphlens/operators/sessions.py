"""Sessions, findings, beliefs and checkpoints as append-only tables of which the latest row holds."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions import scalars as S

SCHEMAS = {
    "sessions": "id string, project string, language string, status string, at timestamp",
    "findings": "id string, session string, kind string, severity string, title string, file string, line int, status string, confidence double, at timestamp",
    "beliefs": "finding string, prior double, likelihood double, posterior double, summary string, at timestamp",
    "checkpoints": "id string, session string, phase string, state string, at timestamp",
}
#: The state that a checkpoint holds, and what a missing part is.
STATE = "phase string, round int, completed array<string>, confirmed array<string>, rejected array<string>, endpoint_count long"


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last row of each key: of equal times the one last by all columns."""
    last = F.max_by(F.struct(*rows.columns), F.struct("at", F.to_json(F.struct(*rows.columns))))
    return rows.groupBy(F.col(key).alias("__key")).agg(last.alias("r")).select("r.*")


class Repository:
    """A folder of tables. Writes append; an update is a later row."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self, name: str) -> DataFrame:
        """All rows ever written."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except Exception as error:  # noqa: BLE001 - only a table that nothing was written to is empty
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name])
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc)

    def save_session(self, project: str, language: str, status: str = "running", key: str = "") -> str:
        key = key or uuid.uuid4().hex
        self.append("sessions", [(key, project, language, status, self.now())])
        return key

    def get_session(self, key: str) -> DataFrame:
        return latest(self.log("sessions").where(F.col("id") == key))

    def update_session_status(self, key: str, status: str) -> None:
        self.append("sessions", self.get_session(key).withColumns({"status": F.lit(status), "at": F.lit(self.now())}))

    def list_sessions(self, status: str | None = None, limit: int = 20) -> DataFrame:
        rows = latest(self.log("sessions"))
        return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("at"), "id").limit(limit)

    def save_findings(self, session: str, findings: DataFrame) -> None:
        """``findings`` (id, kind, severity, title, file, line, status, confidence)."""
        rows = findings.withColumns({"session": F.lit(session), "at": F.lit(self.now())})
        self.append("findings", rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS["findings"].split(", ")]))

    def get_findings(self, session: str) -> DataFrame:
        return latest(self.log("findings").where(F.col("session") == session)).orderBy("id")

    def get_finding_count(self, session: str) -> int:
        return self.get_findings(session).count()

    def update_hypothesis_status(self, finding: str, status: str, confidence: float) -> None:
        row = latest(self.log("findings").where(F.col("id") == finding))
        self.append("findings", row.withColumns({"status": F.lit(status), "confidence": F.lit(float(confidence)), "at": F.lit(self.now())}))

    def record_belief_update(self, finding: str, prior: float, likelihood: float, posterior: float, summary: str = "") -> None:
        self.append("beliefs", [(finding, prior, likelihood, posterior, summary, self.now())])

    def save_checkpoint(self, session: str, phase: str, state: dict, keep: int = 5) -> str:
        key = uuid.uuid4().hex
        self.append("checkpoints", [(key, session, phase, json.dumps(state), self.now())])
        return key

    def list_checkpoints(self, session: str, keep: int | None = 5) -> DataFrame:
        """Oldest first; only the newest ``keep`` count, what is older is pruned by ``prune``."""
        rows = self.log("checkpoints").where(F.col("session") == session)
        if keep is not None:
            order = Window.partitionBy("session").orderBy(F.desc("at"), F.desc("id"))
            rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn")
        return rows.orderBy("at", "id")

    def load_latest(self, session: str) -> dict | None:
        row = self.list_checkpoints(session, 1).first()
        return None if row is None else {"id": row["id"], "phase": row["phase"], "state": json.loads(row["state"])}

    def prune(self, keep: int = 5) -> int:
        """Rewrites the checkpoints with the newest ``keep`` of each session; gives how many went."""
        rows = self.log("checkpoints")
        order = Window.partitionBy("session").orderBy(F.desc("at"), F.desc("id"))
        kept = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn")
        before, spare = rows.count(), f"{self.folder}/checkpoints-{uuid.uuid4().hex}"
        kept.write.parquet(spare)
        left = self.spark.read.schema(SCHEMAS["checkpoints"]).parquet(spare)
        n = left.count()
        left.write.mode("overwrite").parquet(f"{self.folder}/checkpoints")
        return before - n


def state_to_json(rows: DataFrame) -> DataFrame:
    """Adds ``state``: the columns of ``STATE`` as JSON."""
    return rows.withColumn("state", F.to_json(F.struct(*[c.split()[0] for c in STATE.split(", ")])))


def state_from_json(state: Column) -> Column:
    """A state struct; missing parts are empty, zero or none."""
    parsed = F.from_json(state, STATE)
    empty = F.array().cast("array<string>")
    parts = {"phase": F.lit(""), "round": F.lit(0), "completed": empty, "confirmed": empty, "rejected": empty, "endpoint_count": F.lit(0).cast("long")}
    return F.struct(*[F.coalesce(parsed[c], default).alias(c) for c, default in parts.items()])


REQUIRED = {"session": str, "project": str, "language": str, "phase": str}


def validate_state(state: dict, partial: bool = False) -> list[str]:
    """What is wrong with an audit's state: required parts missing (unless ``partial``) or of another kind."""
    wrong = [] if partial else [f"missing: {k}" for k in REQUIRED if k not in state]
    return wrong + [f"not {kind.__name__}: {k}" for k, kind in REQUIRED.items() if k in state and not isinstance(state[k], kind)]


def new_belief(confidence: Column) -> Column:
    """A first belief, never certain."""
    return S.clamp(confidence, 0.01, 0.99)


def belief_history(evidence: DataFrame) -> DataFrame:
    """(finding, step, prior, posterior): Bayes over each finding's evidence (finding, step, initial, given,
    otherwise) in order. Odds multiply, so running sums of their logarithms replace the fold; impossible
    evidence changes nothing."""
    w = Window.partitionBy("finding").orderBy("step")
    likely = (F.col("given") > 0) & (F.col("otherwise") > 0)
    weight = F.when(likely, F.log(F.col("given") / F.col("otherwise"))).otherwise(0.0)
    start = new_belief(F.first("initial").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    odds = F.log(start / (1 - start)) + F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = evidence.select("finding", "step", odds.alias("odds"), weight.alias("weight"))
    chance = lambda x: 1 / (1 + F.exp(-x))
    return rows.select("finding", "step", chance(F.col("odds") - F.col("weight")).alias("prior"), chance(F.col("odds")).alias("posterior"))
