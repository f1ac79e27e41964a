"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of its
labelled texts, lower-cased. A text, lower-cased too, is encoded with each in blocks of ``BLOCK`` bytes,
all of them against the fresh dictionary; the smallest sum of sizes names the language. A
narrow margin to the second rejects: the row is marked, its score is low.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language
with more labelled documents, then the first by name. If no language can be learned all
rows are ``und``; an empty table gives no rows. Very long texts are encoded whole, a block at a time.
Repeated rows are judged alike. Only id, text and lang are read, whatever the other columns are called.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import arrow_map

#: Bounds of the sample and the dictionaries.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 128, 600, 40_000
#: Bytes of text encoded at once: with the dictionary they fit the window, so all of a text counts alike.
BLOCK = 32_768
#: Margins (second smallest size over smallest, less 1) under this are rejected.
MARGIN = 0.02
#: Search for matches of four bytes on; words of prose are short.
SEARCH = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "min_match": 4, "strategy": 4}


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent language first.

    ``documents`` are the labelled ones: doc_id, text, lang. The sample is, for each
    language, the texts with the smallest hashes of their ids.
    """
    usable = documents.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return []
    # one pass: hashes below a cut that lets through twice the sample, then its smallest
    cuts = [(x, 2**63 - 1 if 2 * sample_docs >= n else int(2**64 * 2 * sample_docs / n) - 2**63) for x, n in counts.items()]
    cuts = documents.sparkSession.createDataFrame(cuts, "lang string, cut long")
    chosen = usable.join(F.broadcast(cuts), "lang").where(F.xxhash64("doc_id") <= F.col("cut")).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rank") <= sample_docs)
    rows = ranked.orderBy("lang", "rank").collect()
    texts: dict[str, list] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(r["text"].lower().encode())
    out = []
    for lang in langs:
        content, seen = b"", set()
        for text in texts.get(lang, []):
            if text not in seen and len(content) < dictionary_bytes:
                seen.add(text)
                content += text[: dictionary_bytes - len(content)] + b"\n"
        if len(content) >= 8:
            out.append((lang, content))
    return out


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], margin: float = MARGIN):
        import zstandard

        self.langs, self.margin = [lang for lang, _ in dictionaries], margin
        self.encoders = []
        settings = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            self.encoders.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=d))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = text.lower().encode()
        # short texts repeat, so that their matches outweigh the frame around them
        while len(raw) < 64:
            raw += b"\n" + raw
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(ranked) == 1:
            return self.langs[0], 1.0, False
        first, second = sizes[ranked[0]], sizes[ranked[1]]
        margin = second / first - 1
        return self.langs[ranked[0]], round(margin / (margin + self.margin), 6), margin < self.margin


def classify(documents: DataFrame, dictionaries: list[tuple[str, bytes]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row, from the whole text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICTIONARY_BYTES a language

    def make():
        classifier = Classifier(shared.value)

        def step(columns: list) -> list:
            found = [classifier(t) for t in columns[1]]
            return [columns[0], *([f[i] for f in found] for i in range(3))]

        return step

    return arrow_map(
        documents.select(F.col(id_column).cast("long").alias("doc_id"), text_column), make,
        "doc_id long, lang_pred string, score double, rejected boolean",
        [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())],
    )


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns: learned on the rows that are not held out, applied to all."""
    learned = train(documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return classify(documents, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
