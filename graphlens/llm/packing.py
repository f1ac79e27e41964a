"""Packing of tokenised documents into fixed-length sequences.

Lengths alone decide how items go together, so the plan is made for the histogram of
lengths: at most ``capacity`` - 1 counts, whatever the corpus. Best-fit decreasing makes
kinds of bins with multiplicities, then a swap-based local search exchanges items between
underfull kinds until no exchange gains. Items find their places by rank among those of their
length; whole pieces of ``capacity`` are a sequence each and need no rank.

Null and empty texts are one token (the end mark). Very long texts are cut, not shortened.
Repeated rows, and rows without an id, are packed each. Only id and text are read, whatever
the other columns are called. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, arrow_map

CAPACITY = 2048
#: Ids kept for words that were seen; beyond so many the cache starts anew.
CACHED = 300_000
#: Rows of one length that a task ranks.
RANKED = 200_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across the space before a word, so text is encoded
    word by word through a cache. A space opens a new word only where a character that is
    not white space follows; other white space stays with the word before it. The
    vocabulary's added tokens are cut out of the text first, as they match anywhere.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        # the same vocabulary as ranks: its words cost a fifth of what a tokenizer's call does
        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {x["content"]: np.asarray([x["id"]], dtype="<u4").tobytes() for x in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.known) >= CACHED:
            self.known.clear()
        ids = np.asarray(self.bpe.encode_ordinary(word), dtype="<u4").tobytes()
        if len(word) < 64:
            self.known[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        words = text.split(" ")
        merged = [words[0]]
        for word in words[1:]:
            if word and not word[0].isspace():
                merged.append(" " + word)
            else:
                merged[-1] += " " + word
        known = self.known
        return b"".join([known[w] if w in known else self._word(w) for w in merged])

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not any(x in text for x in self.added):
            return self._plain(text)
        return b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(text)))


#: Encoders of a Python worker, which serves many tasks: words that one of them met stay known.
_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end mark 0,
    cut into pieces of ``capacity`` of which only the first may be shorter."""

    def make():
        encode = encoder(vocabulary)

        def step(columns: list) -> list:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(*columns, strict=True):
                ids = np.frombuffer(encode(text or "") + b"\0\0\0\0", dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if not k else start + capacity]
                    for column, value in zip(out, (key, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            return out

        return step

    key = documents.schema[id_column].dataType
    return arrow_map(
        documents.select(F.col(id_column).cast("long"), text_column), make,
        f"{id_column} long, piece int, start long, length long, ids_crc32 long",
        [(id_column, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())],
    ).withColumn(id_column, F.col(id_column).cast(key))


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins (sorted tuples of lengths) and how many of each.

    Best-fit decreasing on counts: equal bins take equal items together, so the work grows
    with the number of different lengths and not with that of items.
    """
    room: dict[int, Counter] = {}  # by free space, the kinds of bins that have it
    free: list[int] = []

    def put(kind: tuple, n: int) -> None:
        left = capacity - sum(kind)
        if left not in room:
            room[left] = Counter()
            insort(free, left)
        room[left][kind] += n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put((length,) * each, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            left = free[at]
            kind, many = room[left].popitem()
            if not room[left]:
                del room[left]
                free.pop(at)
            each = min(left // length, n)
            moved = min(many, n // each)
            if many > moved:
                put(kind, many - moved)
            put(tuple(sorted(kind + (length,) * each)), moved)
            n -= moved * each
    return sum(room.values(), Counter())


class _Underfull:
    """The underfull kinds of bins, found by a length or by the sum of two that they hold."""

    def __init__(self, bins: Counter, capacity: int):
        self.bins, self.capacity = bins, capacity
        self.fills: dict[tuple, int] = {}
        self.places: tuple[dict[int, set], dict[int, set]] = ({}, {})  # kinds by length, and by sum of two
        self.sizes: tuple[list[int], list[int]] = ([], [])  # their keys, sorted
        for kind in bins:
            self.add(kind)

    @staticmethod
    def parts(kind: tuple) -> tuple[set[int], dict[int, tuple[int, int]]]:
        one = sorted(set(kind))
        return set(one), {a + b: (a, b) for i, a in enumerate(one) for b in one[i:] if a != b or kind.count(a) > 1}

    def add(self, kind: tuple) -> None:
        fill = sum(kind)
        if fill >= self.capacity or kind in self.fills:
            return
        self.fills[kind] = fill
        for places, sizes, found in zip(self.places, self.sizes, self.parts(kind), strict=True):
            for x in found:
                if x not in places:
                    places[x] = set()
                    insort(sizes, x)
                places[x].add(kind)

    def remove(self, kind: tuple) -> None:
        if self.fills.pop(kind, None) is None:
            return
        for places, sizes, found in zip(self.places, self.sizes, self.parts(kind), strict=True):
            for x in found:
                places[x].discard(kind)
                if not places[x]:
                    del places[x]
                    sizes.pop(bisect_left(sizes, x))

    def giver(self, which: int, low: int, high: int, to: tuple, fill: int) -> tuple[int, tuple] | None:
        """The largest size in (low, high] that a kind no fuller than ``to`` holds, and that kind."""
        sizes, places = self.sizes[which], self.places[which]
        for at in range(bisect_right(sizes, high) - 1, bisect_right(sizes, low) - 1, -1):
            fine = [k for k in places[sizes[at]] if self.fills[k] <= fill and (k != to or self.bins[k] > 1)]
            if fine:
                return sizes[at], min(fine, key=lambda k: (self.fills[k], k))
        return None

    def exchange(self, to: tuple):
        """(gives, from it, back to it): of a move, a swap of one for one, two for one or one for two
        that raise the fill of ``to`` by what a bin no fuller loses, the one that raises it most."""
        fill = self.fills[to]
        gap, best, found = self.capacity - fill, 0, None
        one, two = self.parts(to)
        options = [(0, 0, ())] + [(0, b, (b,)) for b in one] + [(1, b, (b,)) for b in one] + [(0, b, pair) for b, pair in two.items()]
        for which, back, items in options:
            if best < gap and (hit := self.giver(which, back + best, back + gap, to, fill)):
                size, kind = hit
                best, found = size - back, (kind, (size,) if not which else self.parts(kind)[1][size], items)
        return found


def improve(bins: Counter, capacity: int) -> Counter:
    """Swap-based local search between underfull kinds of bins.

    Moves a document, or exchanges one for one, two for one or one for two, from a bin no fuller to
    another: the sum of squared fills rises with each. Two kinds change as many bins as both have.
    Every underfull kind is on a list of work, and again when a kind comes about, until no exchange
    between any two of them gains or the number of bins is the least that the total allows.
    """
    bins = Counter(bins)
    least = -(-sum(sum(k) * n for k, n in bins.items()) // capacity)
    under = _Underfull(bins, capacity)
    work, count = sorted(under.fills, key=lambda k: (under.fills[k], k)), sum(bins.values())
    while count > least:
        if not work:  # kinds that gained nothing may do so from those that came later
            work = sorted((k for k in under.fills if under.exchange(k)), key=lambda k: (under.fills[k], k))
            if not work:
                break
        high = work.pop()  # the fullest takes from the others
        if high not in under.fills or (swap := under.exchange(high)) is None:
            continue
        low, out, back = swap
        n = bins[low] // 2 if high == low else min(bins[low], bins[high])
        new_low, new_high = _replace(low, out, back), _replace(high, back, out)
        for kind, change in ((low, -n), (high, -n), (new_low, n), (new_high, n)):
            if not kind:
                count -= n
                continue
            bins[kind] += change
            if not bins[kind]:
                del bins[kind]
                under.remove(kind)
            else:
                under.add(kind)
                if kind in under.fills:
                    work.append(kind)
    return bins


def _replace(kind: tuple, out: tuple, into: tuple) -> tuple:
    items = list(kind)
    for x in out:
        items.remove(x)
    return tuple(sorted(items + list(into)))


def layout(bins: Counter) -> dict[int, tuple[np.ndarray, list[tuple[int, int, list[int]]]]]:
    """By length: first ranks of the runs of slots, and for each run its first sequence, how
    many slots of that length a bin has, and their offsets."""
    slots: dict[int, list] = {}
    taken: Counter = Counter()
    base = 0
    for kind, n in sorted(bins.items(), reverse=True):
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in reversed(kind):
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            slots.setdefault(length, []).append((taken[length], base, places))
            taken[length] += n * len(places)
        base += n
    return {k: (np.array([r[0] for r in runs]), [(b, len(p), p) for _, b, p in runs]) for k, runs in slots.items()}


def pack(documents: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """The pieces with sequence_id and offset; sequences hold at most ``capacity`` ids.

    The rows of a length are dealt to as many parts as they need to be ranked in tasks of ``RANKED``
    rows, so a length that a third of all documents have is no single task.
    """
    spark, store = documents.sparkSession, Scratch(documents.sparkSession, "packing")
    names = [id_column, "piece", "start", "length", "ids_crc32"]
    rows = store.table(pieces(documents, capacity, vocabulary, id_column, text_column), "pieces")
    counts = Counter({r[0]: r[1] for r in rows.groupBy("length").count().collect()})  # at most capacity rows
    full = counts.pop(capacity, 0)
    plan = improve(best_fit(counts, capacity), capacity)
    bins = sum(plan.values())
    own = rows.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return own
    parts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, parts long")
    part = F.pmod(F.xxhash64(id_column, "piece", "start", "ids_crc32"), F.col("parts"))
    rest = rows.where(F.col("length") < capacity).join(F.broadcast(parts), "length").withColumn("part", part).drop("parts")
    before = rest.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "part").orderBy(id_column, "piece", "start", "ids_crc32")
    ranked = rest.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "part"])
    ranked = ranked.select(F.col(id_column).cast("long"), *names[1:], (F.col("first") + F.col("rank")).alias("rank"))
    shared = spark.sparkContext.broadcast(layout(plan))  # at most some slots for each length

    def make():
        runs = shared.value

        def step(columns: list) -> list:
            sequence, offset = [], []
            for length, rank in zip(columns[3], columns[5], strict=True):
                starts, kinds = runs[length]
                at = int(np.searchsorted(starts, rank, side="right")) - 1
                base, each, places = kinds[at]
                number, slot = divmod(rank - int(starts[at]), each)
                sequence.append(base + number)
                offset.append(places[slot])
            return [*columns[:5], sequence, offset]

        return step

    placed = arrow_map(
        ranked, make, f"{id_column} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        [(id_column, pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]],
    ).withColumn(id_column, F.col(id_column).cast(documents.schema[id_column].dataType))
    return placed.unionByName(own) if full else placed
