"""WARC archives: write records, read them back, reassemble segments.

``write_archives`` renders one record per page with DataFrame functions and
saves them through Spark's text writer, whose line separator is the record end,
so any file system that Spark can write takes them. The HTTP block is framed in
chunks (``Transfer-Encoding: chunked``); blocks over ``segment`` bytes are cut
into a first record and continuation records. Equal payloads: the smallest page
id is a response, the others are revisits of it.

``read_archives`` parses every archive, groups continuation records by origin
identifier, orders them by segment number, verifies the total length, decodes
the chunk framing and computes size and digest from the bytes read.

Defined results
* null body: empty payload; null url: empty target. Null page ids sort after
  all others and are read back as null.
* repeated rows: every row is its own record; rows that share the smallest id of
  a payload are all responses.
* very long bodies: segments of fixed size; one body is gathered per row.
* empty table: no archive, empty result. Extra columns are not read.
* a missing segment, a wrong total length, a payload that does not have its declared
  digest and a revisit without its response raise: no row is lost or made up.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
CHUNK, SEGMENT, RECORDS_PER_FILE = 4096, 65_536, 1000
_LAST = (1 << 63) - 1
#: The digits of conv(), the RFC 4648 alphabet.
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 40 hex digits are 4 groups of 8 base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), *_BASE32)


def _bytes(binary: Column) -> Column:
    return binary.cast("string")  # the same bytes; nothing is decoded


def chunked(payload: Column, size: int = CHUNK) -> Column:
    """``payload`` in chunked transfer framing."""
    n = F.octet_length(payload)
    frames = F.transform(F.array(payload), lambda p: F.array_join(F.transform(
        F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.concat(
            F.lower(F.hex(F.least(F.lit(size), n - i))), F.lit("\r\n"),
            _bytes(F.substring(p, i + 1, F.lit(size))), F.lit("\r\n"))), ""))[0]
    return F.concat(F.when(n > 0, frames).otherwise(F.lit("")), F.lit("0\r\n\r\n"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", least_revisit_bytes: int = 0, segment: int = SEGMENT,
                   chunk: int = CHUNK, records_per_file: int = RECORDS_PER_FILE,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (and its continuations) to ``folder``."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        payload.alias("payload"), base32_sha1(payload).alias("digest"))
    order = F.coalesce(F.col("page"), F.lit(_LAST))
    shared = (rows.where(F.octet_length("payload") >= least_revisit_bytes).groupBy("digest")
              .agg(F.min(order).alias("first"), F.max(order).alias("other")).where("other > first")
              .select("digest", "first"))
    rows = rows.join(shared, "digest", "left").withColumn(
        "revisit", F.coalesce((order > F.col("first")) & (F.octet_length("payload") >= least_revisit_bytes), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.when(F.col("revisit"), END[:2]).otherwise(
                        F.concat(F.lit("Transfer-Encoding: chunked" + END), chunked(F.col("payload"), chunk))))
    # The serial keeps the segments of repeated rows apart; results do not depend on it.
    serial = F.monotonically_increasing_id().cast("string")
    name = F.concat_ws(":", F.coalesce(F.col("page").cast("string"), F.lit("")), "digest", serial)
    blocks = rows.select("page", "first", "digest", "revisit", F.regexp_replace("url", r"[\r\n]", "").alias("url"),
                         F.concat(F.lit("<urn:page:"), name).alias("name"), http.cast("binary").alias("block"))
    n = F.ceil(F.octet_length("block") / segment).cast("int")
    parts = blocks.withColumn("total", F.octet_length("block")).withColumn("parts", n).select(
        "*", F.explode(F.sequence(F.lit(1), n)).alias("number"))
    body = F.substring(F.col("block"), (F.col("number") - 1) * segment + 1, F.lit(segment))
    first, last = F.col("number") == 1, F.col("number") == F.col("parts")
    many = F.col("parts") > 1

    def header(title: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{title}: "), value, F.lit("\r\n"))
        return line if when is None else F.when(when, line).otherwise(F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat("name", F.when(first, ">").otherwise(F.concat(F.lit(":"), F.col("number").cast("string"), F.lit(">"))))),
        F.lit(f"WARC-Date: {date}\r\n"), header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(":"), "digest", F.lit(">")), first & F.col("revisit")),
        header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & F.col("revisit")),
        header("WARC-Segment-Number", F.col("number").cast("string"), many),
        header("WARC-Segment-Origin-ID", F.concat("name", F.lit(">")), ~first),
        header("WARC-Segment-Total-Length", F.col("total").cast("string"), many & last),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), _bytes(body))
    (parts.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record in an uncompressed archive."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(fields["content-length"])
        yield fields, data[cut + 4:cut + 4 + n]
        at = cut + 4 + n + 4


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; raises if the framing is broken."""
    out, at = [], 0
    while True:
        cut = body.index(b"\r\n", at)
        n = int(body[at:cut].split(b";")[0], 16)
        at = cut + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def checked_digest(payload: bytes, declared: str | None, name: str) -> str:
    """The digest of ``payload``; raises if the record declares another."""
    found = sha1_base32(payload)
    if declared and declared != found:
        raise ValueError(f"{name}: payload digest {found}, declared {declared}")
    return found


_PARSED = ("origin string, number int, total long, kind string, page string, refers string, "
           "declared string, block binary, payload_bytes long, payload_digest string")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _PARSED.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for f, block in records(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                name, number = f["warc-record-id"].strip("<>"), int(f.get("warc-segment-number", 0))
                kind, origin = f["warc-type"], f.get("warc-segment-origin-id", "").strip("<>") or name
                whole = number == 0 and kind == "response"
                payload = http_payload(block) if whole else None
                declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
                rows.append((origin, number, int(f.get("warc-segment-total-length", 0)), kind,
                             name.split(":")[2], f.get("warc-refers-to", "").strip("<>") or None,
                             declared, block if number else None, len(payload) if whole else None,
                             checked_digest(payload, declared, name) if whole else None))
            yield pd.DataFrame(rows, columns=names)


def _join_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, digests = list(batch["payload_bytes"]), list(batch["payload_digest"])
        for i, (segments, total) in enumerate(zip(batch["segments"], batch["total"], strict=True)):
            if len(segments) == 0:
                continue
            numbers = [s["number"] for s in segments]
            block = b"".join(bytes(s["block"]) for s in segments)
            if numbers != list(range(1, len(numbers) + 1)) or len(block) != total:
                raise ValueError(f"{batch['origin'].iloc[i]}: segments {numbers}, {len(block)} of {total} bytes")
            payload = http_payload(block)
            sizes[i] = len(payload)
            digests[i] = checked_digest(payload, batch["declared"].iloc[i], batch["origin"].iloc[i])
        yield pd.DataFrame({"page": batch["page"], "kind": batch["kind"], "refers": batch["refers"],
                            "declared": batch["declared"], "payload_bytes": pd.array(sizes, "Int64"),
                            "payload_digest": digests})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    parsed = files.mapInPandas(_parse, _PARSED)
    lead = F.col("number") <= 1
    grouped = parsed.groupBy("origin").agg(
        F.max("total").alias("total"), *[F.max(F.when(lead, F.col(c))).alias(c) for c in
                                         ("kind", "page", "refers", "declared", "payload_bytes", "payload_digest")],
        F.array_sort(F.collect_list(F.when(F.col("number") > 0, F.struct("number", "block")))).alias("segments"))
    whole = grouped.mapInPandas(_join_segments, "page string, kind string, refers string, declared string, "
                                                "payload_bytes long, payload_digest string")
    page = lambda c: F.when(c != "", c).cast("long")
    out = whole.select(page(F.col("page")).alias("page_id"), F.col("kind").alias("record_type"), "declared",
                       "payload_bytes", "payload_digest",
                       page(F.element_at(F.split("refers", ":"), 3)).alias("refers_to"))
    held = out.where("record_type = 'response'").groupBy("page_id", F.col("payload_digest").alias("declared")).agg(
        F.max("payload_bytes").alias("held_bytes"))
    revisits = out.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    resolved = revisits.join(held.withColumnRenamed("page_id", "held_page"),
                             (F.col("refers_to") == F.col("held_page")) & (revisits["declared"] == held["declared"]), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(revisits["page_id"].cast("string"), F.lit("null"))))
    resolved = resolved.select(revisits["page_id"], F.coalesce("held_bytes", lost.cast("long")).alias("payload_bytes"),
                               revisits["declared"].alias("payload_digest"), "record_type", "refers_to")
    responses = out.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(resolved)
