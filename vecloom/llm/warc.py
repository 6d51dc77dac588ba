"""WARC archives: written as text by Spark's own committed writer, read back by boundary-chain verification.

Reading: archives are cut into splits. Each task scans its split for the record magic and emits, for every
candidate record, the offset its length leads to; inside a split these links are followed at once to the first offset
outside it. Pointer jumping over the links from each file's start then keeps only offsets that are reachable, so a
magic inside a payload, which no true record leads to, is rejected. The last pass walks each split from its verified entry.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table

MAGIC, CRLF = b"WARC/1.1\r\n", "\r\n"
SPLIT_BYTES, HEADER_BYTES = 8 << 20, 1 << 16
MOST_TASKS = 100_000  # beyond them tasks read several splits, one after the other
#: Bytes of the table of revisits up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n|\Z)")


def base32_sha1(column):
    """Upper-case base32 of the SHA-1 of a binary column: 40 hex digits in eight groups of 20 bits."""
    digits = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", payload: str = "html", url: str = "url") -> None:
    """One record for each row, in as many archives as the input has partitions.

    Of rows with equal payloads of min_bytes or more, that with the largest id is a response, the others are
    revisits without a payload; smaller ones are all responses. Null payloads are empty; rows that share the largest id are all
    responses; a null id is written as empty and counts as the smallest. Payloads of any length are written whole; columns other than the
    id, the payload and the url are not read.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    target = F.coalesce(F.col(url).cast("string"), F.lit("")) if url in pages.columns else F.lit("")
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), body.alias("body"), F.regexp_replace(target, r"[\r\n]", " ").alias("url"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body").cast("bigint"))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    groups = stored(groups, "warc-groups")
    small = groups.count() * 64 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    again = (F.col("keep").isNotNull()) & (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("keep"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(again, F.concat_ws(CRLF, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keep").cast("string"), F.lit(">")))),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    record = F.concat(lines, F.lit(CRLF * 2), F.when(again, "").otherwise(F.col("body")))
    # The record's end is the writer's line separator; the committer keeps archives of failed attempts out.
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).text(path)


class Ranges:
    """Byte ranges of files on the shared file system."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, uri: str, start: int, size: int) -> bytes:
        if uri not in self.open:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            self.open = {uri: system.open_input_file(path)}
        f = self.open[uri]
        f.seek(start)
        return f.read(max(0, size))


def head_at(ranges: Ranges, uri: str, at: int, size: int, have: bytes = b"") -> bytes | None:
    """The header of the record at an offset, without its blank line; None if there is none."""
    step = HEADER_BYTES
    while True:
        end = have.find(b"\r\n\r\n")
        if end >= 0:
            return have[:end]
        if len(have) >= size - at or not have.startswith(MAGIC[: len(have)]):
            return None
        have = ranges.read(uri, at, min(step, size - at))
        step *= 4
        if not have.startswith(MAGIC):
            return None


def successor(head: bytes | None, at: int) -> int | None:
    m = LENGTH.search(head) if head else None
    return at + len(head) + 4 + int(m[1]) + 4 if m else None


def uri_of(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def splits_of(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """uri, size, start, stop of every split; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint")))
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size"), starts.alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size")))


def _links(batches):
    """(uri, at, leaves): a candidate record and the first offset outside its split that its chain reaches."""
    ranges = Ranges()
    for batch in batches:
        for row in batch.to_pylist():
            uri, size, start, stop = uri_of(row["uri"]), row["size"], row["start"], row["stop"]
            data = ranges.read(uri, start, min(stop + len(MAGIC) - 1, size) - start)
            found, at = [], data.find(MAGIC)
            while at >= 0:
                if start + at < stop:
                    found.append(at)
                at = data.find(MAGIC, at + 1)
            leaves: dict[int, int | None] = {}
            for at in reversed(found):
                # The header's end is sought up to HEADER_BYTES further on, else read anew.
                end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
                head = data[at:end] if end >= 0 else head_at(ranges, uri, start + at, size)
                nxt = successor(head, start + at)
                leaves[start + at] = nxt if nxt is None or nxt >= stop else leaves.get(nxt)
            out = [(row["uri"], at, nxt) for at, nxt in leaves.items() if nxt is not None]
            columns = [pa.array([r[i] for r in out], pa.int64() if i else pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["uri", "at", "leaves"])


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?i)\r\n" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].strip().decode("utf-8", "replace") if m else None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _records(with_payload: bool):
    """The records of each split from its verified entry on; one split is held at a time, and of payloads that aren't asked for none."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    n, s = pa.int64(), pa.string()
    schema = pa.schema(list(zip(names, [n, n, s, s, n, s, pa.binary()])))

    def one(ranges: Ranges, row: dict) -> list[tuple]:
        uri, size, stop, at = uri_of(row["uri"]), row["size"], row["stop"], row["entry"]
        base, data, out = at, ranges.read(uri, at, stop - at), []
        while at is not None and at < stop:
            end = data.find(b"\r\n\r\n", at - base)
            head = data[at - base : end] if end >= 0 else head_at(ranges, uri, at, size)
            nxt = successor(head, at) if head and head.startswith(MAGIC) else None
            if nxt is None or nxt > size:
                break  # a cut or damaged archive: what follows isn't reachable
            begin = at + len(head) + 4
            kind, digest = _field(head, b"WARC-Type"), _field(head, b"WARC-Payload-Digest") or ""
            digest, count = digest.removeprefix("sha1:"), _field(head, b"WARC-Payload-Length")
            payload = None
            if kind == "response":
                payload = data[begin - base : nxt - 4 - base] if nxt - 4 <= base + len(data) else ranges.read(uri, begin, nxt - 4 - begin)
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest and own != digest:
                    raise ValueError(f"{uri}: the payload at {at} doesn't have the digest that its header says")
                digest, count = own, len(payload)
            record = (_page(_field(head, b"WARC-Record-ID")), int(count) if count is not None else None, digest, kind, _page(_field(head, b"WARC-Refers-To")))
            out.append((*record, _field(head, b"WARC-Target-URI"), payload) if with_payload else record)
            at = nxt
        return out

    def run(batches):
        ranges = Ranges()
        for batch in batches:
            for row in batch.to_pylist():
                out = one(ranges, row)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(schema.types)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of every reachable record.

    Each archive must start with a record. Where a record is cut off or damaged the rest of its archive isn't reachable and is left out;
    a response whose payload doesn't have the digest of its header raises an error. Revisits have a null payload.
    """
    splits = stored(splits_of(spark, path, split_bytes), "warc-splits")
    n = max(1, splits.count())
    tasks = splits.repartition(min(n, MOST_TASKS))
    links = stored(tasks.mapInArrow(_links, "uri string, at bigint, leaves bigint"), "warc-links")
    # Only files' starts and offsets that some chain leaves to can be entries of splits: a few rows a split.
    entries = splits.where("start = 0").select("uri", F.lit(0).cast("bigint").alias("at")).union(links.select("uri", F.col("leaves").alias("at"))).distinct()
    jump = stored(links.join(entries, ["uri", "at"], "left_semi"), "warc-jump")
    reach = splits.where("start = 0").select("uri", F.lit(0).cast("bigint").alias("at"))
    known = -1
    while True:
        # Reached offsets take one jump each, then jumps double: the rounds are the logarithm of splits a file.
        reach = stored(reach.union(reach.join(jump, ["uri", "at"]).select("uri", F.col("leaves").alias("at"))).distinct(), "warc-reach")
        count = reach.count()
        if count == known:
            break
        known = count
        onward = jump.select("uri", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        jump = stored(jump.join(onward, ["uri", "leaves"], "left").select("uri", "at", F.coalesce("further", "leaves").alias("leaves")).union(jump).distinct(), "warc-jump")
    at_split = reach.withColumn("start", F.col("at") - F.pmod(F.col("at"), F.lit(split_bytes).cast("bigint")))
    first = at_split.groupBy("uri", "start").agg(F.min("at").alias("entry"))
    work = splits.join(first, ["uri", "start"]).repartition(min(n, MOST_TASKS))
    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * with_payload
    return work.mapInArrow(_records(with_payload), out)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False)


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
           list_sum(list_transform(range(5), lambda b: (
             ((position(substr(hex, CAST(((5 * i + b) // 4) + 1 AS INTEGER), 1) IN '0123456789abcdef') - 1) // CAST(2 ** (3 - (5 * i + b) % 4) AS INTEGER)) % 2
           ) * CAST(2 ** (4 - b) AS INTEGER)))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""
