"""Benchmark decontamination with a positional inverted index over the corpus.

``build_index`` stores the postings of all words of all documents, in segments of whole
documents: a segment's terms, and for each term the sorted positions where it stands.
``search`` counts the test words over all segments, then intersects, for each window of benchmark
words, the offset-adjusted position lists from the corpus' rarest term on; no posting is
shuffled, as a segment holds all that its documents need. Benchmark windows go to the tasks in
blocks of a stated size, one block at a time.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null or
empty texts have no words and are never hit; a very long text is a segment of its own. Repeated
rows and repeated windows count by themselves; items of equal id are one item in ``n_items``, and
items without an id are left out. Empty tables give no rows, or no hits. Only ids and texts are
read, whatever the other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, row_key, without

WINDOW = 10
#: Bytes of text after which a segment ends; bounds a task's memory.
SEGMENT_BYTES = 2_000_000
#: Benchmark items that one pass over the index takes, and bytes of their texts.
ITEM_BLOCK, ITEM_BYTES = 2_000, 8_000_000

#: Separators to spaces, A-Z to a-z; bytes from 0x80 on belong to words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
SEGMENT = "keys binary, doc_ids binary, missing binary, starts binary, terms binary, offsets binary, positions binary"
FIELDS = pa.schema([(n.split()[0], pa.binary()) for n in SEGMENT.split(", ")])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _segment(ids: list, keys: list[int], texts: list[list[bytes]]) -> list[bytes]:
    """Postings of some documents. A document's words stand one after another; a gap of one
    position after each document keeps phrases within it."""
    number: dict[bytes, int] = {}
    tokens: list[int] = []
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    for i, found in enumerate(texts):
        tokens += [number.setdefault(w, len(number)) for w in found]
        tokens.append(-1)
        starts[i + 1] = len(tokens)
    stream = np.array(tokens, dtype=np.int32)
    order = np.argsort(stream, kind="stable").astype(np.int32)[len(ids) :]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(stream[stream >= 0], minlength=len(number)))])
    known = np.array([x if x is not None else 0 for x in ids], dtype=np.int64)
    missing = np.array([x is None for x in ids], dtype=np.int8)
    return [np.array(keys, dtype=np.int64).tobytes(), known.tobytes(), missing.tobytes(), starts.tobytes(), b" ".join(number), offsets.astype(np.int64).tobytes(), order.tobytes()]


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of the positional index, one row each."""

    def row(*parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _segment(*parts)], schema=FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts, size = [], [], [], 0
        for batch in batches:
            for own, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(own)
                keys.append(key)
                texts.append(words(text))
                size += len(text or b"") + 16
                if size >= segment_bytes:
                    yield row(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
        if ids:
            yield row(ids, keys, texts)

    return documents.select(F.col(id_column).cast("long"), row_key(id_column, text_column), F.col(text_column).cast("binary")).mapInArrow(run, SEGMENT)


class Segment:
    """A stored segment, opened for look-ups."""

    def __init__(self, row: list[bytes]):
        keys, known, missing, starts, terms, offsets, positions = row
        self.keys, self.ids = np.frombuffer(keys, dtype=np.int64), np.frombuffer(known, dtype=np.int64)
        self.missing = np.frombuffer(missing, dtype=np.int8)
        self.starts = np.frombuffer(starts, dtype=np.int64)
        self.number = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.offsets = np.frombuffer(offsets, dtype=np.int64)
        self.positions = np.frombuffer(positions, dtype=np.int32)
        self.sizes = np.diff(self.offsets)
        self.width = int(self.starts[-1])
        self._lists = None

    @property
    def lists(self) -> np.ndarray:
        """All posting lists as one ascending array of term and position, so that many
        intersections are one search."""
        if self._lists is None:
            self._lists = np.repeat(np.arange(len(self.sizes), dtype=np.int64) * self.width, self.sizes) + self.positions
        return self._lists

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.offsets[term] : self.offsets[term + 1]]

    def phrases(self, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window row, start position) of all exact occurrences of the windows, which are
        rows of term numbers, all of one length; ``order`` has their places by rarity."""
        none = np.empty(0, dtype=np.int64)
        if not len(windows):
            return none, none
        rare = np.take_along_axis(windows, order[:, :1], 1)[:, 0]
        n = self.sizes[rare]
        which = np.repeat(np.arange(len(windows)), n)
        # the rarest term's list of each window, less the term's offset in the window
        at = self.positions[np.arange(n.sum()) + np.repeat(self.offsets[rare] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)].astype(np.int64)
        at -= order[which, 0]
        keep = (at >= 0) & (at + windows.shape[1] <= self.width)
        which, at = which[keep], at[keep]
        for k in range(1, windows.shape[1]):
            if not len(at):
                break
            offset = order[which, k]
            wanted = windows[which, offset] * self.width + at + offset
            place = np.minimum(np.searchsorted(self.lists, wanted), len(self.lists) - 1)
            keep = self.lists[place] == wanted
            which, at = which[keep], at[keep]
        return which, at

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest term with each other term at most ``slop`` positions away
        in the same document."""
        terms = sorted(set(terms), key=lambda t: self.sizes[t])
        at = self.postings(terms[0]).astype(np.int64)
        document = np.searchsorted(self.starts, at, side="right")
        for term in terms[1:]:
            other = self.postings(term).astype(np.int64)
            keep = np.zeros(len(at), dtype=bool)
            for side in (-1, 0):
                i = np.clip(np.searchsorted(other, at) + side, 0, len(other) - 1)
                keep |= (np.abs(other[i] - at) <= slop) & (np.searchsorted(self.starts, other[i], side="right") == document)
            at, document = at[keep], document[keep]
        return at


def windows_of(items: list[tuple[int, list[bytes]]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Items by window; an item of fewer words, but not none, is one window."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for item, found in items:
        for i in range(max(len(found) - size, 0) + 1 if found else 0):
            owners = out.setdefault(tuple(found[i : i + size]), [])
            if item not in owners:
                owners.append(item)
    return out


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of ``terms`` (those of a block of items) stands in the corpus."""
    shared = index.sparkSession.sparkContext.broadcast(terms)
    out = pa.schema([("term", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for names, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(offsets, dtype=np.int64))
                here = [(t, int(sizes[i])) for i, t in enumerate(names.split(b" ") if names else ()) if t in asked]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in here], type=f.type) for k, f in enumerate(out)], schema=out)

    rows = index.select("terms", "offsets").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {bytes(r["term"]): r["n"] for r in rows}


def search(index: DataFrame, items: list[tuple[int, bytes]], store: Scratch, name: str, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, hits, items, place) for each document, stored: word positions in any
    occurrence of a window, as ascending array<int>, and the ids of the items with occurring
    windows. Windows with a word that the corpus lacks are not sent out."""
    windows = windows_of([(i, words(t)) for i, t in items], size)
    counts = term_counts(index, {t for w in windows for t in w})
    vocabulary = {t: i for i, t in enumerate(sorted(counts))}
    by_length: dict[int, list[tuple[bytes, ...]]] = {}
    for w in windows:
        if all(t in counts for t in w):
            by_length.setdefault(len(w), []).append(w)
    groups = []
    for length, group in sorted(by_length.items()):
        numbers = np.array([[vocabulary[t] for t in w] for w in group], dtype=np.int64).reshape(-1, length)
        rarity = np.array([counts[t] for t in sorted(counts)], dtype=np.int64)[numbers]
        groups.append((length, numbers, np.argsort(rarity, axis=1, kind="stable"), [windows[w] for w in group]))
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, groups))
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, groups = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                part = Segment([c[i].as_py() for c in batch.columns])
                n = len(part.ids)
                hit = np.zeros(part.width + 1, dtype=np.int32)
                by_doc: dict[int, set] = {}
                local = np.full(len(vocabulary), -1, dtype=np.int64)
                for t in vocabulary.keys() & part.number.keys():
                    local[vocabulary[t]] = part.number[t]
                for length, numbers, order, owners in groups:
                    here = local[numbers]
                    rows = np.flatnonzero((here >= 0).all(axis=1))
                    which, at = part.phrases(here[rows], order[rows])
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + length, -1)
                    for doc, w in set(zip((np.searchsorted(part.starts, at, side="right") - 1).tolist(), rows[which].tolist(), strict=True)):
                        by_doc.setdefault(doc, set()).update(owners[w])
                marked = np.flatnonzero(np.cumsum(hit) > 0)
                bounds = np.searchsorted(marked, part.starts)
                hits = [(marked[bounds[d] : bounds[d + 1]] - part.starts[d]).tolist() for d in range(n)]
                found = [sorted(by_doc.get(d, ())) for d in range(n)]
                columns = [pa.array(part.ids, mask=part.missing.astype(bool)), pa.array(part.keys), pa.array(np.diff(part.starts) - 1), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    found = store.table(index.mapInArrow(run, "doc_id long, key long, n_words long, hits array<int>, items array<long>"), name)
    shared.destroy()  # one block's windows at a time
    return found


def proximity(index: DataFrame, query: str, slop: int) -> DataFrame:
    """(doc_id, position): where all the query's words stand within ``slop`` words."""
    asked = words(query.encode())
    out = pa.schema([("doc_id", pa.int64()), ("position", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Segment([c[i].as_py() for c in batch.columns])
                if asked and all(w in part.number for w in asked):
                    at = part.near([part.number[w] for w in asked], slop)
                    doc = np.searchsorted(part.starts, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(part.ids[doc], mask=part.missing[doc].astype(bool)), pa.array(at - part.starts[doc])], schema=out)

    return index.mapInArrow(run, "doc_id long, position long")


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in blocks of so many items or ``ITEM_BYTES``; only one block is on the
    driver at a time."""
    rows, items, size = benchmark.select("item_id", F.col("text").cast("binary")).where("item_id is not null").toLocalIterator(), [], 0
    for item, text in rows:
        items.append((item, bytes(text or b"")))
        size += len(items[-1][1])
        if len(items) >= block or size >= ITEM_BYTES:
            yield items
            items, size = [], 0
    if items:
        yield items


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, hits, items) for each document over all items; key is ``row_key``.

    The index is stored first, and goes when the results are. If there is more than one block of
    items, the index is searched once for each, and the results of equal rows (equal id and text,
    so equal hits) are put together.
    """
    store = Scratch(documents.sparkSession, "decontam")
    index = store.table(build_index(documents), "index")
    found = [search(index, items, store, f"found-{k}", size) for k, items in enumerate(item_blocks(benchmark))] or [search(index, [], store, "found", size)]
    rows = found[0]
    if len(found) > 1:
        for more in found[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("doc_id", "key", "n_words").agg(
            (F.count("*") / len(found)).cast("long").alias("copies"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    return store.keep(rows, "found")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """The documents of which at most ``share`` of the words are hit, all columns kept. A verdict
    goes by id and text, so rows without an id, or with another's, have their own."""
    found = contamination(documents, benchmark).where((F.size("hits") > 0) & (F.size("hits") > F.lit(share) * F.col("n_words")))
    return without(documents, row_key(), found.select("key"))
