"""The surface for models and tools: protocols, a loop that asks again, a loop that calls tools.

A model is any callable from messages to a structured answer; tests and offline runs use
``stand_in``. Tables are judged with ``judged``, which runs a scorer over Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

Message = dict[str, Any]
StopHook = Callable[[dict], "str | None"]


class Model(Protocol):
    """Answers messages with an object of a schema."""

    def __call__(self, messages: list[Message], schema: dict) -> dict: ...


class Tool(Protocol):
    name: str
    parameters: dict

    def execute(self, **arguments: Any) -> Any: ...


@dataclass
class Result:
    ok: bool
    value: Any = None
    error: str = ""


class Tools:
    """Tools by name; an unknown name or a failure is a result, not an exception."""

    def __init__(self, tools: list[Tool]):
        self.known = {t.name: t for t in tools}

    def execute(self, name: str, **arguments: Any) -> Result:
        if name not in self.known:
            return Result(False, error=f"no tool called {name}")
        try:
            return Result(True, self.known[name].execute(**arguments))
        except Exception as error:  # noqa: BLE001 - the caller is told
            return Result(False, error=f"{type(error).__name__}: {error}")


def stop_on_empty(key: str = "hypotheses") -> StopHook:
    return lambda answer: f"no {key} given" if not answer.get(key) else None


def stop_on_low_confidence(threshold: float = 0.3) -> StopHook:
    def hook(answer: dict) -> str | None:
        found = [x.get("confidence", 0) for x in answer.get("hypotheses", [])]
        return f"all below {threshold}" if found and max(found) < threshold else None

    return hook


def stop_on_missing_verdict(answer: dict) -> str | None:
    return "inconclusive without a reason" if answer.get("verdict") == "inconclusive" and not answer.get("reasoning") else None


INTENT = re.compile(r"\b(?:let me|i will|i'll|next,? i|continu(?:e|ing)|going to)\b", re.I)


def means_to_continue(text: str) -> bool:
    return bool(INTENT.search(text or ""))


@dataclass
class Nudged:
    answer: dict
    turns: int
    nudges: list[str] = field(default_factory=list)


def nudge_loop(model: Model, messages: list[Message], schema: dict, hooks: tuple[StopHook, ...] = (), most: int = 5, each: int = 2) -> Nudged:
    """Asks again while a hook objects or the answer says it goes on: ``most`` turns, ``each`` times a reason."""
    messages, nudges, answer = list(messages), [], {}
    for turn in range(1, most + 1):
        answer = model(messages, schema)
        reasons = [r for h in hooks if (r := h(answer))]
        if means_to_continue(str(answer.get("text", ""))):
            reasons.append("go on")
        reason = next((r for r in reasons if nudges.count(r) < each), None)
        if reason is None:
            return Nudged(answer, turn, nudges)
        nudges.append(reason)
        messages += [{"role": "assistant", "content": answer}, {"role": "user", "content": f"Please answer again: {reason}."}]
    return Nudged(answer, most, nudges)


def trimmed(messages: list[Message], keep: int = 3, most: int = 8000) -> list[Message]:
    """Blanks all but the last ``keep`` tool results and cuts these to ``most`` characters."""
    tools = [i for i, m in enumerate(messages) if m.get("role") == "tool"]
    shown = set(tools[len(tools) - keep :]) if keep else set()
    return [m if m.get("role") != "tool" else m | {"content": str(m["content"])[:most] if i in shown else "(left out)"} for i, m in enumerate(messages)]


def agent_loop(model: Model, messages: list[Message], schema: dict, tools: Tools, most: int = 10) -> dict | None:
    """One tool a turn until the model gives its answer; none after ``most`` turns."""
    messages = list(messages)
    for _ in range(most):
        step = model(trimmed(messages), schema)
        if "tool" not in step:
            return step
        done = tools.execute(step["tool"], **step.get("arguments", {}))
        messages += [{"role": "assistant", "content": step}, {"role": "tool", "content": done.value if done.ok else done.error}]
    return None


def stand_in(messages: list[Message], schema: dict) -> dict:
    """A verdict that depends on the text alone."""
    value = zlib.crc32(str(messages[-1].get("content", "")).encode()) % 1000 / 1000
    return {"verdict": "confirmed" if value >= 0.5 else "inconclusive" if value >= 0.2 else "rejected", "confidence": value, "reasoning": "by checksum"}


def judged(rows: DataFrame, model: Model = stand_in, key: str = "id", text: str = "text") -> DataFrame:
    """(id, verdict, confidence, reasoning): each row's text judged by a model; a failure is inconclusive at 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x in batch[text]:
                try:
                    a = model([{"role": "user", "content": x or ""}], {})
                    found.append((a.get("verdict", "inconclusive"), float(a.get("confidence", 0.5)), a.get("reasoning", "")))
                except Exception as error:  # noqa: BLE001 - a model that fails decides nothing
                    found.append(("inconclusive", 0.5, type(error).__name__))
            yield pd.DataFrame({"id": batch[key], "verdict": [f[0] for f in found], "confidence": [f[1] for f in found], "reasoning": [f[2] for f in found]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"id {kind}, verdict string, confidence double, reasoning string")


def hypotheses(answers: DataFrame) -> DataFrame:
    """(id, title, kind, severity, confidence, stable_key): rows of the JSON answers (id, json) with a list of hypotheses;
    of equal keys the first."""
    from pyspark.sql import functions as F

    kinds = "array<struct<title:string,vuln_type:string,severity:string,confidence:double,source_location:string,sink_location:string>>"
    each = answers.select("id", F.posexplode(F.from_json(F.get_json_object("json", "$.hypotheses"), kinds)).alias("n", "h")).select("id", "n", "h.*")
    key = F.concat_ws("|", F.coalesce("source_location", F.lit("")), F.coalesce("sink_location", F.lit("")), F.coalesce("vuln_type", F.lit("")))
    first = each.withColumn("stable_key", key).groupBy("stable_key").agg(F.min(F.struct("id", "n", "title", "vuln_type", "severity", "confidence")).alias("h"))
    return first.select("h.id", "h.title", F.col("h.vuln_type").alias("kind"), "h.severity", "h.confidence", "stable_key")
