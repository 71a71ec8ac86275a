"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, work_path

#: What each record starts with, up to the minor version.
MAGIC = "WARC/1."
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Up to so many repeated digests are sent to the executors; more of them are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
DATE = "2000-01-01T00:00:00Z"

_BASE16 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def base32_sha1(content: Column) -> Column:
    """The bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(content)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), _BASE16, _BASE32)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row of pages, in archives (plain WARC/1.1 files) below path.

    Of rows with equal payloads of at least min_bytes bytes, that of the largest id is a response and the
    others are revisits that refer to it; rows that share payload and largest id are all responses.
    A null payload is empty, a null id is never referred to while another is not null, a null url is
    left out and control characters in it become blanks. The text writer makes the files: each row is
    a record without its last byte, which is the line separator, so any file system Spark writes to
    will do and lost tasks are written again.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html")), "print": F.xxhash64("html")})
    # Payloads are equal if their SHA-1, their size and a second hash are.
    same = ["digest", "size", "print"]
    shared = rows.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(*same, "first_id")
    shared = materialize(shared, "shared-digests")
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(shared) if few else shared, same, "left")
    revisit = (F.col("size") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END + _END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ")
    lines = F.concat_ws(
        _END,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("Payload-Length: "), F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(lines, F.lit(_END + _END), block, F.lit("\r\n\r"))
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


_HEADER = re.compile(rb"[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)*)\r\n")
_FIELDS = {b"warc-type": "type", b"warc-record-id": "id", b"warc-target-uri": "url", b"warc-refers-to": "refers_to", b"warc-payload-digest": "digest", b"payload-length": "payload_length", b"content-type": "content_type"}
_CANDIDATE = "file string, block long, at long, size long, next long, exit long, head long, type string, id string, url string, refers_to string, digest string, payload_length string, content_type string, body_sha1 string, body_bytes long, raw binary"
_NAMES = [f.split()[0] for f in _CANDIDATE.split(", ")]


def _header(chunk: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of the header, bytes of the block, fields) of a record whose magic was cut off; None if it is none."""
    m = _HEADER.match(chunk)
    if not m:
        return None
    fields, length = {}, None
    for line in m[1].split(b"\r\n")[:-1]:
        key, _, value = line.partition(b":")
        key, value = key.lower(), value.strip()
        if key == b"content-length":
            length = int(value) if value.isdigit() and len(value) < 19 else None
        elif key in _FIELDS:
            fields.setdefault(_FIELDS[key], value.decode(errors="replace"))
    return (m.end(), length, fields) if length is not None else None


def payload(block: bytes, content_type: str | None) -> bytes:
    """The payload of a block: what follows the HTTP header, if there is one."""
    if (content_type or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at each magic: a row for each piece, in file order within each block of a file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of the archives, with the record it would be and where that record's successor would start.

    Offsets at, next and exit count from where the block's first piece starts. A piece whose record
    is complete (the next magic follows right after it) has its payload's digest; the bytes of a piece
    are kept only where a record before it in the block is not complete yet. exit is where the chain
    from a record leaves the block, null where it runs into a place that is no record.
    """
    magic = len(MAGIC)

    def flush(held: list[dict], size: int) -> Iterator[pa.RecordBatch]:
        exits: dict[int, int | None] = {}
        for row in reversed(held):
            if row["next"] is not None:
                row["exit"] = exits[row["at"]] = row["next"] if row["next"] >= size else exits.get(row["next"])
        for lo in range(0, len(held), 5000):
            part = held[lo : lo + 5000]
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(_NAMES, _CANDIDATE.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held, wanted = None, 0, [], 0
        for batch in batches:
            for file, block, file_size, value in zip(*(batch.column(i) for i in range(4)), strict=True):
                file, block, file_size, chunk = file.as_py(), block.as_py(), file_size.as_py(), value.as_py()
                if (file, block) != key:
                    if key is not None:
                        yield from flush(held, at)
                    key, at, held, wanted = (file, block), 0, [], 0
                # A piece starts after its magic; the first piece of a file has none and is no record.
                row = dict.fromkeys(_NAMES) | {"file": file, "block": block, "at": at, "size": len(chunk) + magic}
                found = _header(chunk)
                if found and found[0] + found[1] + 4 <= file_size - block:
                    head, length, fields = found
                    whole = head + length + 4
                    row |= fields | {"head": head, "next": at + magic + whole}
                    if whole == len(chunk) and chunk.endswith(b"\r\n\r\n"):
                        body = payload(chunk[head:-4], fields.get("content_type"))
                        row |= {"body_sha1": _digest(body), "body_bytes": len(body)}
                    else:
                        wanted = max(wanted, at + magic + whole)
                if at < wanted:
                    row["raw"] = chunk
                held.append(row)
                at += len(chunk) + magic
        if key is not None:
            yield from flush(held, at)

    return _chunks(spark, path).mapInArrow(run, _CANDIDATE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, id, url, refers_to, digest, payload_bytes, payload_digest) of each true record.

    Each task cuts its byte range at the magic and emits candidates with their successors' offsets, and
    within its range follows them to where they leave it. What is left is a chain over ranges: pointer
    jumping from each file's start, doubling the distance each round, retains the candidates that are
    entered, and each range's own chain from there is its true records. Magic inside a payload is never
    reached. A record whose payload holds the magic lies in several pieces; it is put together from them.
    payload_bytes and payload_digest are computed from what was read; for a revisit they are the header's.
    An empty folder of archives gives no record; a file that does not start with a record has none.
    """
    found = materialize(candidates(spark, path), "candidates")
    # Where a range's first piece starts is what all ranges before it in the file have read.
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The first piece of a file has no magic before it: all offsets are that much less.
    starts = sizes.select("file", "block", "bytes", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    starts = materialize(starts, "ranges")
    placed = found.join(starts, ["file", "block"])
    records = placed.where(F.col("next").isNotNull()).select("file", "block", "base", "at", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("next")).alias("next"), (F.col("base") + F.col("exit")).alias("exit"))
    records = materialize(records, "records")
    # Only a file's start and where chains leave ranges can be entries; most records of a range share one exit.
    targets = records.where("exit IS NOT NULL").select("file", F.col("exit").alias("offset")).distinct()
    entries = records.join(targets.unionByName(records.select("file").distinct().withColumn("offset", F.lit(0).cast("long"))), ["file", "offset"], "left_semi")
    jump = materialize(entries.select("file", "offset", F.col("exit").alias("to")), "jump")
    reached = materialize(jump.where("offset = 0").select("file", "offset"), "reached")
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset")).join(jump.select("file", "offset"), ["file", "offset"], "left_semi")
        more = materialize(ahead.join(reached, ["file", "offset"], "left_anti").distinct(), "reached")
        if more.isEmpty():
            break
        reached = materialize(reached.unionByName(more), "reached")
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        jump = materialize(jump.join(far, ["file", "to"], "left").select("file", "offset", F.col("far").alias("to")), "jump")

    def walk(pdf):
        """The chain within one range from where it is entered; a range is bounded by its bytes."""
        following = dict(zip(pdf["offset"], pdf["next"], strict=True))
        seen, at = [], next((o for o, e in zip(pdf["offset"], pdf["entered"], strict=True) if e), None)
        while at in following:
            seen.append(at)
            at = following[at]
        return pdf[pdf["offset"].isin(seen)][["file", "block", "at", "offset", "next"]]

    entered = records.join(reached.withColumn("entered", F.lit(True)), ["file", "offset"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    true = entered.select("file", "block", "at", "offset", "next", "entered").groupBy("file", "block").applyInPandas(walk, "file string, block long, at long, offset long, next long")
    true = materialize(true, "true-records")
    details = found.select("file", "block", "at", "size", "head", "type", "id", "url", "refers_to", "digest", "payload_length", "content_type", "body_sha1", "body_bytes")
    full = materialize(true.join(details, ["file", "block", "at"]), "details")
    split = full.where("body_sha1 IS NULL")
    bodies = _assemble(spark, path, found, starts, split) if not split.isEmpty() else None
    if bodies is not None:
        full = full.join(bodies, ["file", "offset"], "left").withColumns({"body_sha1": F.coalesce("body_sha1", "whole_sha1"), "body_bytes": F.coalesce("body_bytes", "whole_bytes")})
    revisit = F.col("type") == "revisit"
    stated = F.regexp_extract("digest", "^sha1:([A-Z2-7]{32})$", 1)
    return full.select(
        "file", "offset", "type", "id", "url", "refers_to", "digest",
        F.when(revisit, F.expr("try_cast(payload_length AS BIGINT)")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("body_sha1")).alias("payload_digest"),
    )


def _assemble(spark: SparkSession, path: str, found: DataFrame, starts: DataFrame, split: DataFrame) -> DataFrame:
    """Digests of the records that lie in several pieces, each put together from the pieces in its span.

    Pieces that a range kept are taken from the candidates. A record may also go on into later ranges,
    whose first pieces were not kept; there is at most one such record for each range, and those ranges'
    pieces are read again from the archives.
    """
    magic = len(MAGIC)
    spans = split.select("file", "block", "offset", "next", "head", "content_type")
    placed = found.join(starts, ["file", "block"]).select("file", "block", (F.col("base") + F.col("at")).alias("piece"), "size", "raw")
    owned = placed.join(spans.select("file", F.col("offset").alias("piece"), F.col("offset").alias("own"), F.col("next").alias("stop")), ["file", "piece"], "left")
    # Within a range the record before a piece owns it, else the last one that went on from a range before:
    # windows are over one range's offsets, and over the ranges of a file. The pieces' bytes stay out of them.
    tails = spans.join(starts, ["file", "block"]).where((F.col("next") > F.col("base") + F.col("bytes"))).select("file", "block", F.col("offset").alias("tail"), F.col("next").alias("tail_stop"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.join(tails, ["file", "block"], "left").select("file", "block", F.last("tail", True).over(earlier).alias("tail"), F.last("tail_stop", True).over(earlier).alias("tail_stop"))
    order = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    inside = owned.select("file", "block", "piece", F.last("own", True).over(order).alias("own"), F.last("stop", True).over(order).alias("stop")).join(carried, ["file", "block"])
    inside = inside.select("file", "block", "piece", F.coalesce("own", "tail").alias("offset"), F.when(F.col("own").isNotNull(), F.col("stop")).otherwise(F.col("tail_stop")).alias("stop")).where("piece < stop").select("file", "block", "piece", "offset")
    inside = materialize(inside, "spans")
    kept = placed.where("raw IS NOT NULL").select("file", "piece", "raw").join(inside, ["file", "piece"]).select("file", "offset", "piece", "raw")
    missing = materialize(inside.join(placed.where("raw IS NULL").select("file", "piece"), ["file", "piece"], "left_semi"), "missing")
    pieces = kept
    if not missing.isEmpty():
        bases = starts.join(missing.select("file", "block").distinct(), ["file", "block"])
        few = bases.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, at = None, 0
            for batch in batches:
                places = []
                for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                    if (file, block) != key:
                        key, at = (file, block), 0
                    places.append(at)
                    at += len(value.as_py()) + magic
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(3)], ["file", "block", "at", "raw"])

        again = _chunks(spark, path).mapInArrow(number, "file string, block long, at long, raw binary")
        again = again.join(F.broadcast(bases) if few else bases, ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("piece"), "raw")
        pieces = pieces.unionByName(again.join(missing.select("file", "piece", "offset"), ["file", "piece"]).select("file", "offset", "piece", "raw"))

    def join(pdf):
        pdf = pdf.sort_values("piece")
        data = MAGIC.encode().join(bytes(x) for x in pdf["raw"])
        head, stop = int(pdf["head"].iloc[0]), int(pdf["next"].iloc[0] - pdf["offset"].iloc[0]) - magic
        body = payload(data[head : stop - 4], pdf["content_type"].iloc[0])
        return pdf[["file", "offset"]].head(1).assign(whole_sha1=_digest(body), whole_bytes=len(body))

    return pieces.join(spans.drop("block"), ["file", "offset"]).groupBy("file", "offset").applyInPandas(join, "file string, offset long, whole_sha1 string, whole_bytes long")


def round_trip(pages: DataFrame, *, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, offset) of each page, read back.

    The pages are written with write_archives() to a new folder in the shared folder and read with
    read_archives().
    """
    spark = pages.sparkSession
    path = work_path(spark, "archives")
    write_archives(pages, path, min_bytes=min_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    return read_archives(spark, path).select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"), "url", "file", "offset",
    )
