"""WARC archives of pages, written and read back.

Records are UTF-8 text, so Spark's text writer makes the archives: a record is a line
whose separator is the two CRLF that end it. Reading splits at the version line, wherever
it stands; tasks work on byte ranges. Each candidate gives its offset and that of its
successor, and pointer jumping from the file's start keeps only reachable records. A
version line inside a payload opens a candidate that no chain reaches; its text goes back
to the record around it. Archives of versions 1.0 and 1.1 are read, header names in any case.

Null html is an empty payload, a null url an empty one. Very long payloads are one record; what
lies between two version lines is one row. Empty tables make no archives and no rows. Repeated
page ids make a record each; equal rows may refer to any of their equals, which have one id.
Only id, url and html are read, whatever the other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, without

#: Fixed: what opens a record, before the version's last number; that after a line break, as headers
#: hold it only so; the profile of revisits.
VERSION = "WARC/1."
MAGIC = "\r\n" + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Payloads smaller than this are always written in full.
REVISIT_BYTES = 1000


def records(pages: DataFrame, store: Scratch) -> DataFrame:
    """The records' texts, one for each page.

    Of pages with equal payloads of ``REVISIT_BYTES`` or more, that with the largest id is
    the response. Digests are counted before they meet, so a payload that a third of all
    pages share is one row by task; payloads themselves stay where they are read, as a revisit
    is written without one.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"size": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary"))}
    )
    large = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "url", "size", "sha1")
    firsts = large.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    again = store.table(large.join(firsts, "sha1").where("first <> page_id"), "revisits")
    key = F.xxhash64("page_id", "sha1")
    full = without(rows, key, store.table(again.select(key.alias("k")).distinct(), "revisit-keys"))
    named = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))

    def record(fields: list[tuple[str, Column]], payload: Column) -> Column:
        lines = [x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
        return F.concat(F.lit(VERSION + "1\r\n"), *lines[:-1], F.lit(END), payload).alias("record")

    def fields(kind: str, length: Column) -> list[tuple[str, Column]]:
        return [
            ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", named(F.col("page_id"))), ("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),  # header lines hold no line breaks
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("X-Payload-Length", F.col("size").cast("string")), ("Content-Length", length),
        ]

    of = fields("response", F.col("size").cast("string")) + [("Content-Type", F.lit("text/html; charset=utf-8"))]
    to = fields("revisit", F.lit("0")) + [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", named(F.col("first")))]
    return full.select(record(of, F.col("html"))).unionByName(again.select(record(to, F.lit(""))))


def write(pages: DataFrame, path: str, store: Scratch, records_per_file: int = 65536, compression: str = "none") -> None:
    """Archives under ``path``; the last two CRLF are those of the last record. Tasks read byte
    ranges of plain ones; with ``gzip`` a file is one member, read in one task, so ``records_per_file``
    bounds its size."""
    records(pages, store).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).mode("overwrite").text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, body): what lies between one version line and the next, in the order
    n of the byte range that starts at block."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("body"),
    )


def _header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def candidates(pieces: DataFrame) -> DataFrame:
    """A row for each piece, without its body: its size with what opens it, its header
    block, the length that the header gives, and digest and size of the payload it holds.
    Without a version line, a whole header or a length there is no successor."""
    # the line break that opens the next piece may be the one that ends the header
    text = F.concat(F.col("body").cast("string"), F.lit("\r\n"))
    head = F.substring_index(text, END, 1)
    rows = pieces.withColumn("head", F.when((F.instr(text, END) > 0) & head.rlike(rf"^(?:\Q{VERSION}\E)?[0-9]\r\n"), head))
    rows = rows.withColumn("length", _header(F.col("head"), "Content-Length").try_cast("long"))
    start = F.octet_length("head") + len(END) + 1
    rows = rows.withColumn("payload", F.substring("body", start, F.least(F.col("length"), F.lit(2**31 - 1)).cast("int")))
    return rows.select(
        "file", "block", "n", (F.octet_length("body").cast("long") + len(MAGIC)).alias("size"), "head", "length", F.md5("body").alias("key"),
        F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("held"),
    )


def offsets(rows: DataFrame) -> DataFrame:
    """Adds off, the position of what opens a piece, and succ, where the next
    record must open. Text before a file's first version line has no row.

    A byte range's first offset is the sum of what the ranges before it gave; only these sums
    meet by file.
    """
    blocks = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.withColumn("begin", F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).select("file", "block", "begin")
    inside = Window.partitionBy("file", "block").orderBy("n")
    # a piece stands after what opens it, which counts to the piece before; a file's first piece
    # has its version line in it and nothing before it
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(blocks, ["file", "block"])
    rows = rows.withColumn("off", F.col("begin") + F.col("upto") - F.col("size") - len(MAGIC))
    rows = rows.where((F.col("off") >= 0) | F.coalesce(F.col("head").startswith(VERSION) & (F.col("off") == -len(MAGIC)), F.lit(False)))
    return rows.withColumn("succ", F.col("off") + len(MAGIC) + F.octet_length("head") + len(END) + F.col("length") + len(END) - 2).drop("upto", "begin", "n", "block")


def reachable(links: DataFrame, store: Scratch) -> DataFrame:
    """(file, off) of the candidates that the chain from a file's first piece reaches.

    ``links``: (file, off, succ). Pointer jumping: in each round the marked candidates mark
    where they jump to, then all jumps double; a chain of n records takes log2(n) rounds.
    """
    here = links.select("file", "off", F.col("succ").alias("jump"), (F.col("off") == -len(MAGIC)).alias("r"))
    turn = 0
    here = store.table(here, f"jumps-{turn}")
    while True:
        marks = here.where("r and jump is not null").select("file", F.col("jump").alias("off"), F.lit(True).alias("m"))
        steps = here.select("file", F.col("off").alias("jump"), F.col("jump").alias("next"))
        if not here.where("r and jump is not null").limit(1).count():
            return here.where("r").select("file", "off")
        here = here.join(marks.distinct(), ["file", "off"], "left").join(steps, ["file", "jump"], "left").select(
            "file", "off", F.col("next").alias("jump"), (F.col("r") | F.coalesce("m", F.lit(False))).alias("r")
        )
        turn += 1
        here = store.table(here, f"jumps-{turn}")
        store.drop(f"jumps-{turn - 1}")


def read(spark: SparkSession, path: str, store: Scratch, payloads: bool = False) -> DataFrame:
    """(file, off, type, uri, id, refers_to, digest, payload_length, bytes, sha1) of all
    records, bytes and sha1 of the payload as it was read; with ``payloads``, the payload too.
    """
    rows = store.table(offsets(store.table(candidates(segments(spark, path)), "pieces")), "candidates")
    real = store.table(reachable(rows.select("file", "off", "succ"), store), "reachable")
    rows = rows.join(real.withColumn("real", F.lit(True)), ["file", "off"], "left")
    # pieces that no chain reaches belong to the record before them; only in files that have
    # such pieces do the places of pieces meet
    odd = rows.where("real is null").select("file").distinct()
    owner = F.last(F.when(F.col("real"), F.col("off")), True).over(Window.partitionBy("file").orderBy("off"))
    parts = rows.select("file", "off", "real", "key").join(odd, "file", "left_semi").withColumn("owner", owner).where("owner is not null")
    broken = parts.where("real is null").select("file", "owner").distinct()
    parts = store.table(parts.join(broken, ["file", "owner"], "left_semi").select("file", "owner", "off", "key"), "parts")
    records = rows.where("real and length is not null").drop("real")
    wanted = records.select("file", "off", "key").withColumn("owner", F.col("off")).select("file", "owner", "off", "key").unionByName(parts).distinct() if payloads else parts
    bodies = segments(spark, path).select("file", F.md5("body").alias("key"), "body").join(wanted.select("file", "key").distinct(), ["file", "key"], "left_semi").dropDuplicates(["file", "key"])
    magic = F.lit(MAGIC).cast("binary")
    whole = wanted.join(bodies, ["file", "key"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "body"))).alias("p")).select(
        "file", F.col("owner").alias("off"), F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.get("p", F.lit(0))["body"], lambda acc, x: F.concat(acc, magic, x["body"])).alias("body")
    )
    start = F.octet_length("head") + len(END) + 1
    records = records.join(whole, ["file", "off"], "left").withColumn("payload", F.substring("body", start, F.least(F.col("length"), F.lit(2**31 - 1)).cast("int")))
    out = records.select(
        "file", "off", _header(F.col("head"), "WARC-Type").alias("type"), _header(F.col("head"), "WARC-Target-URI").alias("uri"),
        _header(F.col("head"), "WARC-Record-ID").alias("id"), _header(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _header(F.col("head"), "WARC-Payload-Digest").alias("digest"), _header(F.col("head"), "X-Payload-Length").try_cast("long").alias("payload_length"),
        F.coalesce(F.octet_length("payload").cast("long"), "held").alias("bytes"), F.coalesce(F.sha1("payload"), "sha1").alias("sha1"), "payload",
    )
    return out if payloads else out.drop("payload")


def page_of(column: Column) -> Column:
    return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The query's columns, from the archives as read back."""
    store = Scratch(pages.sparkSession, "warc")
    path = store.path("archives")
    write(pages, path, store)
    rows = read(pages.sparkSession, path, store)
    response = F.col("type") == "response"
    return rows.select(
        page_of(F.col("id")).alias("page_id"),
        F.when(response, F.col("bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
    )
