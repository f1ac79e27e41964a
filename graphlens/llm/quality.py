"""Document quality by a learned decision list.

Statistics of whole texts, then rules learned from labelled statistics by sequential
covering: a rule is a conjunction of thresholds, grown while it gains information on one
part of the sample and pruned on the other. The list is ordered and becomes one Spark
conditional expression; documents that no rule rejects are kept.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail the base
rules; very long texts are measured whole. Repeated rows are judged alike, rows of one id and
different texts each by its text; several labels of one id count as its lowest. Without labels
of both kinds the list is empty; an empty table stays empty. Columns pass as they are, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import Scratch

#: Labelled ids that the rules are learned from at most, those with the smallest hashes.
SAMPLE = 20_000
#: Thresholds tried for a feature: so many quantiles of what is to be rejected.
QUANTILES = 48
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops")
#: What the rules test; each from the counts above.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "stop_share", "words_a_line")
UPPERCASE, DIGITS = bytes(range(0x41, 0x5B)), b"0123456789"


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text."""
    text = text or b""
    found = text.split()  # bytes split at ASCII white space only
    n = len(found)
    code_points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if text else 0
    blank = len(text) - len(text.translate(None, SPACES))
    triples = list(zip(found, found[1:], found[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        times, last = Counter(triples), -1
        for i, triple in enumerate(triples):
            if times[triple] > 1:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (
        n, len(text) - code_points - blank, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(set(found)), len(text) - len(text.translate(None, UPPERCASE)), len(text) - len(text.translate(None, DIGITS)),
        sum(text.count(c) for c in (b".", b"!", b"?")),
    )


def statistics(documents: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, the counts): row is a struct of the ``carry`` columns (all, if not given), one for each document."""
    kept = list(dict.fromkeys([*(documents.columns if carry is None else carry), text_column]))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    kinds = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(kept.index(text_column)).cast(pa.binary())
            found = np.array([measure(t) for t in texts.to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=["row", *COUNTS])

    return rows.mapInArrow(run, kinds)


def features() -> dict[str, Column]:
    """The tested values as expressions over the counts."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "stop_share": share("n_stops", "n_words"), "words_a_line": share("n_words", "n_lines"),
    }


Condition = tuple[int, bool, float]  # feature, whether at least, threshold
Rule = tuple[Condition, ...]


def covers(rule: Rule, x) -> bool:
    return all((x[f] >= t) == up for f, up, t in rule)


def _covered(rule: Rule, rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), dtype=bool)
    for f, up, t in rule:
        out &= (rows[:, f] >= t) == up
    return out


def _grow(bad: np.ndarray, good: np.ndarray) -> Rule:
    """A conjunction that covers many of ``bad`` and few of ``good``: each condition is that
    of most information gain among thresholds at quantiles."""
    rule: list[Condition] = []
    p, n = bad, good
    while len(n) and len(rule) < 4:
        before, best = np.log2(len(p) / (len(p) + len(n))), (1e-9, None)
        for f in range(bad.shape[1]):
            mine, others = np.sort(p[:, f]), np.sort(n[:, f])
            values = np.unique(mine)
            values = np.append(values[:: max(1, len(values) // QUANTILES)], values[-1])
            above = (len(p) - np.searchsorted(mine, values), len(n) - np.searchsorted(others, values))
            for up in (True, False):
                a, b = above if up else (len(p) - above[0], len(n) - above[1])
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - before), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, up, float(values[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        p, n = (x[_covered((best[1],), x)] for x in (p, n))
    return tuple(rule)


def learn(rows: list[tuple[tuple[float, ...], bool]], precision: float = 0.9) -> list[Rule]:
    """Rules that reject, in order. ``rows``: (features, whether bad). Every third row prunes.

    A rule enters the list if it is right for ``precision`` of what it covers in the rows for
    pruning, counted with one more right and one more wrong, so that clean documents stay; else
    the bad rows that it covers are left and the next rule is grown from the others.
    """
    if not rows:
        return []
    x, y = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=bool)
    prune = np.arange(len(rows)) % 3 == 0
    bad, good, bad2, good2 = (x[part & kind] for part in (~prune, prune) for kind in (y, ~y))
    rules: list[Rule] = []
    while len(bad) and len(good):
        rule = _grow(bad, good)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            a, b = _covered(r, bad2).sum(), _covered(r, good2).sum()
            return ((a - b) / (a + b) if a + b else -1.0, len(r))

        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        a, b = _covered(best, bad2).sum(), _covered(best, good2).sum()
        bad = bad[~_covered(best, bad)]
        if (a + 1) / (a + b + 2) >= precision:
            rules.append(best)
            good, bad2, good2 = (part[~_covered(best, part)] for part in (good, bad2, good2))
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; 0 if none does."""
    values, out = list(features().values()), None
    for k, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for f, up, t in rule:
            fits = fits & ((values[f] >= F.lit(t)) if up else (values[f] < F.lit(t)))
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(0) if out is None else out.otherwise(0)


BASE = "n_words < 50 or n_repeat_words * 100 > n_words * 50"


def training_rows(documents: DataFrame, labels: DataFrame, store: Scratch, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> list[tuple[tuple[float, ...], bool]]:
    """At most ``sample`` labelled documents that pass the base rules, in the order of their ids'
    hashes. Only these are measured, and no task gives more than its share of them."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min("quality").alias("quality"))
    judged = store.table(judged.withColumn("h", F.xxhash64("key")), "labels")
    n = judged.count()
    if n > sample:  # the smallest hashes: a cut a little above what is wanted, then the limit
        judged = judged.where(F.col("h") <= min(2**63 - 1, int(2**64 * 1.1 * sample / n) - 2**63))
    chosen = judged.orderBy("h", "key").limit(sample).select("key", "quality", "h")
    rows = documents.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "key")
    measured = statistics(rows, "text", ["quality", "h", "key"]).where(f"not ({BASE})").select("row.h", "row.key", F.struct(*features().values(), F.col("row.quality").alias("quality")).alias("x"))
    found = measured.groupBy("h", "key").agg(F.min("x").alias("x")).orderBy("h", "key").collect()
    return [(tuple(r["x"][:-1]), r["x"][-1] == 0) for r in found]


def judge(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, the counts, base_failed, rule, kept), one row for each document: rule is 0 where none
    fits, row a struct of the ``carry`` columns. The verdict stays with the row: nothing is shuffled."""
    rules = learn(training_rows(documents, labels, Scratch(documents.sparkSession, "quality"), id_column, text_column))
    found = statistics(documents, text_column, carry).withColumn("base_failed", F.expr(BASE)).withColumn("rule", expression(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    found = judge(documents, labels, carry=["doc_id"])
    return found.select("row.doc_id", "n_words", *COUNTS[1:5], "base_failed", "kept", F.col("rule").cast("long").alias("rule"))
