"""Jaccard self-join of documents' shingle sets under several global token orders.

Documents with equal sets form a class; classes are joined. A prefix of a set, long enough
that two linked sets must share a token of it, is taken under each of three global orders. Two large
sets share such a token by chance, and the short sketch says nothing of them: their buckets
are those of two consecutive tokens of a prefix twice as long, of which linked sets must share one too.
All orders put common tokens last, by a sketch of the document frequencies of all shingles,
and break ties by different hashes. Pairs must share a prefix token under every order
before their whole sets are compared: inside the join where buckets are full or hold several
groups, else right after it. Odd sketches bound what two sets can share: a bit for each part of
the hashes, set if an odd number of a set's shingles fall there, differs in two sets at most once
for each shingle that only one of them has, so pairs beyond the limit go without a look at
their texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a set holds 64-bit hashes of the
distinct shingles (of all words, if fewer than a shingle has). Null, empty and wordless texts
have no shingles and link with nothing. Repeated rows are copies: they share a class and a
component. Only id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, arrow_map, id_bitmap, in_bitmap, without
from graphlens.llm.components import link_through_buckets

#: Counters of the sketch: a fixed size, so that it can be broadcast.
SKETCH = 1 << 18
#: Bits of every set's short odd sketch, and bounds of those of the long one, which has a bit or more
#: for each shingle between them.
ODD, NARROWEST, WIDEST = 256, 1024, 1 << 20
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Words(dict):
    """64-bit hashes of words, kept while the task runs."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = (text or b"").lower().split()  # bytes: ASCII only, as white space is
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(size, len(found))
    out = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(MIX[0]) + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which a set with at least percent % similarity has one."""
    return n - -(-n * percent // 100) + 1


def _slot(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(46)).astype(np.int64)


def sketch(documents: DataFrame, size: int) -> np.ndarray:
    """Counts of all documents' shingles by hash, in ``SKETCH`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(SKETCH, dtype=np.int64), Words()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, _slot(shingles(text, size, known)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    rows = documents.select(F.col("text").cast("binary")).mapInArrow(run, "slot long, n long")
    total = np.zeros(SKETCH, dtype=np.int64)
    for slot, n in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SKETCH rows
        total[slot] = n
    return total


def levels(counts: np.ndarray) -> np.ndarray:
    """How far a counter stands above its like, in doublings: 0 for the usual ones."""
    usual = max(1.0, float(np.median(counts)))
    spread = 6 * np.sqrt(usual) + 2
    return np.where(counts <= usual + spread, 0, np.ceil(np.log2(1 + np.maximum(counts - usual, 0)))).astype(np.uint64)


def _rank(found: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Places in a global order: common hashes last, else by one of several hashes."""
    return (level << np.uint64(56)) | (_mix(found ^ np.uint64(MIX[order])) >> np.uint64(8))


def prefix(found: np.ndarray, level: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first hashes in a global order, not sorted by it."""
    return found[np.argpartition(_rank(found, level, order), length - 1)[:length]] if length < len(found) else found


def large(percent: int) -> int:
    """Size from which on the short odd sketch rules out hardly any pair of sets that have little in common."""
    return (ODD // 2 - 16) * (100 + percent) // (2 * max(1, 100 - percent)) if 3 * percent > 200 else 1 << 62


def bucket_keys(found: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two linked sets share one: the prefix under the first order for sets that may have a partner
    below ``large``, runs of two consecutive tokens for those from there on.

    Linked sets differ in d = n * (100 - percent) / percent tokens at most, n being the smaller size. Of the d + 1
    pairs in the first 2 * (d + 1) tokens of their union one is whole in both sets, consecutive in
    both, and among the first 2 * (d + 1) tokens of both.
    """
    n, least, out = len(found), large(percent), []
    if n and n * percent <= least * 100:
        out.append(prefix(found, levels[_slot(found)], 0, prefix_length(n, percent)))
    if n >= least:
        first = prefix(found, levels[_slot(found)], 0, 2 * (n * (100 - percent) // percent + 1))
        first = first[np.argsort(_rank(first, levels[_slot(first)], 0))]
        out.append(_mix(_mix(first[:-1]) * np.uint64(MIX[1]) + first[1:]))
    return np.concatenate(out) if out else found


def odd_sketch(found: np.ndarray, bits: int) -> bytes:
    """A bit for each part of the hashes: whether an odd number of ``found`` falls there."""
    slots = (found >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the shorter one's size."""
    a, b = (np.frombuffer(s, dtype=np.uint8) for s in sorted((x, y), key=len))
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def signatures(documents: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """(row, doc_id, n, set, rare, o1, o2, o3, o4, wide, p1, p2, p3): size and fingerprint of each set,
    how many of its shingles are not common, its odd sketches, its bucket keys, and its prefixes under the
    other orders (as 16-bit hashes, which can only add candidates)."""
    shared = documents.sparkSession.sparkContext.broadcast(level)

    def make():
        import xxhash

        known, level = Words(), shared.value
        short = lambda x: np.unique(x >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)

        def step(columns: list) -> list:
            out: list[list] = [[] for _ in range(12)]
            for key, text in zip(*columns, strict=True):
                found = shingles(text, size, known)
                p = prefix_length(len(found), percent) if len(found) else 0
                own = level[_slot(found)]
                one, two, three = bucket_keys(found, level, percent), *(prefix(found, own, k, p) for k in (1, 2))
                wide = odd_sketch(found, min(WIDEST, max(NARROWEST, 1 << len(found).bit_length())))
                odd = np.frombuffer(odd_sketch(found, ODD), dtype=np.int64).tolist()
                values = (key, len(found), xxhash.xxh3_128_digest(found.tobytes()), int((own == 0).sum()), *odd, wide, one.view(np.int64), short(two), short(three))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return out

        return step

    kinds = {"doc_id": "long", "n": "long", "set": "binary", "rare": "long", "o1": "long", "o2": "long", "o3": "long", "o4": "long", "wide": "binary", "p1": "array<long>", "p2": "array<short>", "p3": "array<short>"}
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<short>": pa.list_(pa.int16())}
    rows = arrow_map(documents.select("doc_id", F.col("text").cast("binary")), make, ", ".join(f"{c} {k}" for c, k in kinds.items()), [(c, types[k]) for c, k in kinds.items()])
    return rows.withColumn("row", F.monotonically_increasing_id())


def within(percent: int, differ, total):
    """Whether two sets of ``total`` shingles together that differ in ``differ`` at least can be similar enough."""
    return differ * (100 + percent) <= total * (100 - percent)


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, t): the words of the documents in ``ids`` (id) and a few others, compressed: hashes
    of shingles would take three times as much in the shuffles.

    A bitmap of the ids goes to the scan, so that most other texts stop there; it has
    a fixed size, and what passes it by chance finds no partner in the joins that follow.
    """
    mask = id_bitmap(ids)
    shared = documents.sparkSession.sparkContext.broadcast(mask)
    out = pa.schema([("id", pa.int64()), ("t", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, mask = zstandard.ZstdCompressor(level=1), shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(in_bitmap(mask, batch.column(0).to_numpy())))
            packed = [pack.compress(b" ".join((t.as_py() or b"").lower().split())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], schema=out)

    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "id long, t binary")


def verified(pairs: DataFrame, signed: DataFrame, documents: DataFrame, size: int, percent: int, store: Scratch) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the other orders, pass the sketches and whose
    whole sets are similar enough. ``signed``: (id, n, wide, p2, p3)."""
    side = lambda i, x: signed.select(F.col("id").alias(i), F.struct("n", "wide", "p2", "p3").alias(x))

    def closer():
        def step(columns: list) -> list:
            near = [(a, b) for a, b, total, x, y in zip(*columns, strict=True) if within(percent, apart(x, y), total)]
            return [[p[0] for p in near], [p[1] for p in near]]

        return step

    ends, tag = [("a", pa.int64()), ("b", pa.int64())], f"pairs-{uuid.uuid4().hex}"
    shared = F.arrays_overlap("x.p2", "y.p2") & F.arrays_overlap("x.p3", "y.p3")
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(shared)
    pairs = arrow_map(pairs.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("total"), F.col("x.wide").alias("w"), F.col("y.wide").alias("v")), closer, "a long, b long", ends)
    pairs = store.table(pairs, tag)

    def compare():
        import zstandard

        known, unpack, last = Words(), zstandard.ZstdDecompressor(), [None, None]
        found = lambda t: shingles(unpack.decompress(t), size, known)

        def step(columns: list) -> list:
            out: list[list] = [[], []]
            for a, b, x, y in zip(*columns, strict=True):
                if x != last[0]:  # a pivot's pairs come one after another
                    last[:] = x, found(x)
                x, y = last[1], found(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out[0].append(a)
                    out[1].append(b)
            return out

        return step

    store.tidy()
    # texts go from the scan into the joins and are not stored; those of the pivots are fewer
    near, pivot = (texts_of(documents, pairs.select(F.col(c).alias("id")).distinct()) for c in ("b", "a"))
    joined = pairs.join(near.select(F.col("id").alias("b"), F.col("t").alias("y")), "b").join(pivot.select(F.col("id").alias("a"), F.col("t").alias("x")), "a")
    return arrow_map(joined.select("a", "b", "x", "y"), compare, "a long, b long", ends)


def groups(documents: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    component_id is the least doc_id that links reach; a row without shingles has its own id,
    one without an id has none and links with nothing. Rows of equal id are one document:
    what one of them links with, all do.
    """
    store = Scratch(documents.sparkSession, "ngram-join")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store.table(signatures(documents, levels(sketch(documents, size)), size, percent), "signatures")
    # a class is a set; the first row of the least id among its documents stands for it
    full = signed.where("n > 0 and doc_id is not null").select("row", "doc_id", "set")
    classes = store.table(full.groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("h")).select("set", F.col("h.doc_id").alias("id"), "h.row"), "classes")
    others = store.table(full.join(classes.select("set", F.col("row").alias("head")), "set").where("row <> head").select("row"), "others")
    heads = without(signed.where("n > 0 and doc_id is not null"), F.col("row"), others).withColumnRenamed("doc_id", "id")
    several = full.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("doc_id")
    same = full.select("doc_id", "set").join(several, "doc_id", "left_semi").join(classes.select("set", "id"), "set").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    same = store.table(same.where("a <> b").distinct(), "same")
    rows = store.table(signed.select("doc_id", "n", "set"), "rows")
    made = []

    def prepare(ids: DataFrame) -> None:
        made.append(store.table(heads.select("id", "n", "o1", "o2", "o3", "o4", "wide", "p2", "p3"), "marks"))

    # size and how common the shingles are, in one number that orders pivots by the latter
    postings = heads.select(F.explode("p1").alias("key"), "id", F.shiftleft("rare", 32).bitwiseOR(F.col("n")).alias("item"))
    count = lambda side: side("item").bitwiseAND(F.lit(2**32 - 1))

    def near(x, y):
        n, m = count(x), count(y)
        return (n * 100 >= m * percent) & (m * 100 >= n * percent)

    def alike(x, y):
        differ = sum((F.bit_count(x(o).bitwiseXOR(y(o))) for o in ("o2", "o3", "o4")), F.bit_count(x("o1").bitwiseXOR(y("o1"))))
        return within(percent, differ, count(x) + count(y))

    def resplit(full: DataFrame) -> DataFrame:
        """By the prefix tokens of the second order: a linked pair shares one of them too."""
        return full.join(made[0].select("id", "p2"), "id").withColumn("key", F.explode(F.transform("p2", lambda t: F.xxhash64("key", t)))).drop("p2")

    found = link_through_buckets(
        postings, ["item"], near, lambda pairs: verified(pairs, made[0].select("id", "n", "wide", "p2", "p3"), documents, size, percent, store), store,
        lambda: made[0].select("id", "o1", "o2", "o3", "o4"), alike, resplit, given=same, spent="signatures", prepare=prepare,
    )
    roots = classes.join(found, "id", "left").select("set", F.coalesce("root", "id").alias("component_id"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(roots, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return store.keep(out, "found")


def representatives(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group, that of the least id; all columns kept. Of rows
    of equal id and group all stay; rows without an id stay."""
    gone = groups(documents, size, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return without(documents, F.col("doc_id").cast("long"), gone)
