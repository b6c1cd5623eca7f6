"""WARC writing and reading by boundary-chain verification.

An archive folder holds plain WARC/1.1 files. Tasks read byte ranges and emit every place where
the magic line stands as a candidate record with its successor's offset; pointer jumping from the
start of each file keeps only candidates that the chain reaches, so a magic line inside a payload
is never taken for a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 4096
BROADCAST_ROWS = 200_000     # most rows of a table that is broadcast
BIN = 1 << 20                # bytes; records meet false magic lines by the bins they span
# Digits of Java's radix 32 and of RFC 4648 base32, in order.
RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 (five hex digits at a time are four base32 digits)."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0"), RADIX32, BASE32) for i in range(8)]
    return F.concat(*parts)


def checked_broadcast(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows (narrow rows: some
    20 MB); beyond that the join shuffles."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to for rows ``(page_id, url, html)``.

    Null html is the empty payload. Of equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id is the response, the others revisit it (rows that repeat that page_id are
    responses too; so are rows without a page_id in a group without any). Only ids and digests are
    shuffled to find the revisits; payloads only where there are too many of those to broadcast.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    ids = stored(p.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").count())
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = stored(ids.join(first, "digest").where("refers_to is not null and not page_id <=> refers_to")
                           .select(F.col("digest").alias("d"), F.col("page_id").alias("id"), "refers_to"))
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("id"))
    return p.join(checked_broadcast(revisits), same, "left").select("page_id", "url", "payload", "bytes", "digest", "refers_to")


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows of ``plan_records`` as WARC files under ``path``. A revisit record has no block:
    its digest and length are those of the payload it refers to."""
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(END))
    record = F.concat(header, F.when(revisit, "").otherwise(F.col("payload")))
    records.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, start, inside, len, seg: what stands behind each magic line up to the next one.

    The text reader cuts at the magic line and splits large files; ``inside`` counts the bytes from
    the first segment of the byte range (``start``) that the task reads.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.octet_length("value").cast("bigint") + len(MAGIC)).alias("len"), F.col("value").alias("seg"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, 0
        for b in batches:
            inside = []
            for where, n in zip(zip(b["file"].to_pylist(), b["start"].to_pylist()), b["len"].to_pylist()):
                if where != own:
                    own, at = where, 0
                inside.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([b["file"], b["start"], pa.array(inside, pa.int64()), b["len"], b["seg"]],
                                             ["file", "start", "inside", "len", "seg"])

    return raw.mapInArrow(place, "file string, start bigint, inside bigint, len bigint, seg string")


def reachable(candidates: DataFrame) -> DataFrame:
    """The rows ``(file, at, next)`` that the chain ``at -> next`` reaches from offset 0 of each file.

    Pointer jumping: the set reached doubles its depth each round, so a file of n records takes
    about log2(n) rounds of joins.
    """
    jump = candidates.select("file", "at", "next")
    reached = stored(jump.where("at = 0").select("file", "at"))
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        new = ahead.join(candidates.select("file", "at"), ["file", "at"], "left_semi").distinct()
        more = stored(new.join(reached, ["file", "at"], "left_anti"))
        if more.isEmpty():
            return reached
        reached = stored(reached.union(more))
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, header, payload of every true record under ``path``. A file that does not start
    with a record gives no rows, nor does an empty folder.

    The bytes are read twice: once for the chain, once for the payloads. They are shuffled only
    where the segments that false magic lines cut off are too many to broadcast their places.
    """
    segs = _segments(spark, path)
    header = F.substring_index("seg", END, 1)
    length = F.regexp_extract(header, r"(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|$)", 1)
    size = F.when(F.col("seg").contains(END) & (length != ""),
                  F.octet_length(header) + len(MAGIC) + 2 * len(END) + length.cast("bigint"))
    found = stored(segs.select("file", "start", "inside", "len", size.alias("size")))
    ranges = found.groupBy("file", "start").agg(F.sum("len").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    # the first segment of a file ends where its first magic line starts, hence the shift
    ranges = ranges.select("file", "start", (F.coalesce(before, F.lit(0)) - len(MAGIC)).alias("base"))
    placed = found.join(ranges, ["file", "start"]).select("file", "start", "inside", (F.col("base") + F.col("inside")).alias("at"), "size")
    cand = stored(placed.select("file", "start", "inside", "at", (F.col("at") + F.col("size")).alias("next")))
    true = reachable(cand.where("next is not null"))
    rest = stored(cand.join(true, ["file", "at"], "left_anti").select("file", "start", "inside", "at"))
    stray = rest.where("at >= 0")
    key = ["file", "start", "inside"]
    whole = segs.join(checked_broadcast(rest.select(*key)), key, "left_anti").select(*key, "seg")
    if not stray.isEmpty():
        # a false magic line cuts a payload in two: its pieces go back to the record that holds them
        ends = true.join(cand, ["file", "at"]).select("file", F.col("at").alias("owner"), "next", *[F.col(c).alias(f"o_{c}") for c in key[1:]])
        spans = ends.withColumn("bin", F.explode(F.sequence(F.floor(F.col("owner") / BIN), F.floor((F.col("next") - 1) / BIN))))
        owned = (stray.withColumn("bin", F.floor(F.col("at") / BIN)).join(spans, ["file", "bin"])
                 .where("at > owner and at < next").select(*key, "at", "o_start", "o_inside"))
        parts = (segs.join(checked_broadcast(owned), key).groupBy("file", F.col("o_start").alias("start"), F.col("o_inside").alias("inside"))
                 .agg(F.array_sort(F.collect_list(F.struct("at", "seg"))).alias("parts"))
                 .select(*key, F.array_join(F.transform("parts", lambda p: F.concat(F.lit(MAGIC), p["seg"])), "").alias("more")))
        whole = whole.join(parts, key, "left").select(*key, F.concat("seg", F.coalesce("more", F.lit(""))).alias("seg"))
    h = F.substring_index("seg", END, 1)
    body = F.substring("seg", F.length(h) + len(END) + 1, F.length("seg") - F.length(h) - 2 * len(END))
    return whole.select("file", h.alias("header"), body.alias("payload"))


def field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of rows of ``read_warc``. Length
    and digest of a response are taken from the payload read back; those of a revisit from its header."""
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?[0-9]+)>", 1)
    kind, number = field("WARC-Type"), lambda c: F.when(c != "", c.cast("bigint"))
    response = kind == "response"
    return records.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(field("X-Payload-Length").cast("bigint")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload").cast("binary"))).otherwise(F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1)).alias("payload_digest"),
        kind.alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"))
