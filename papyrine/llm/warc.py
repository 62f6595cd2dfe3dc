"""WARC archives: write captures as records, read them back, and assemble transactions.

Each capture is three records: a request, a response (or a revisit of an earlier response with the same
payload) and metadata.  Request and metadata name the response's or revisit's record id in WARC-Concurrent-To;
assembly joins on that id and emits one nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.numbering import number_rows
from papyrine.llm.scratch import Scratch, kept_by, prepare_python

VERSION = "WARC/1.1"
MIN_REVISIT_BYTES = 100
#: Most bytes of payload in one archive file, unless one payload is larger; a file is read whole by one task.
FILE_BYTES = 32 << 20
#: Size classes of payloads, and bytes that the records of a capture take besides.
CLASS_BYTES, RECORD_BYTES = (1 << 12, 1 << 16, 1 << 20), 2048
CRLF = "\r\n"
RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("warc_type", pa.string()),
        ("target_uri", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("content", pa.binary()),
    ]
)


def _urn(kind: str, *key: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(k.cast("string"), F.lit("-")) for k in key]))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value holds no line breaks."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its last byte, which the text writer adds as line separator.

    A header whose value is null is left out.
    """
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))]
    head = F.concat(F.lit(VERSION + CRLF), *[F.coalesce(x, F.lit("")) for x in lines])
    return F.concat(head, block, F.lit(CRLF + "\r"))


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one transaction per row of (id, url, html) as uncompressed WARC files below ``path``.

    Of rows with equal payloads of ``MIN_REVISIT_BYTES`` or more, the one with the smallest id is the
    response, the others revisit it; rows of null id revisit it too, and are all responses where no row has an id.
    A null html is an empty payload, a null url an empty target; rows of null id are captures without captureId.
    Rows that repeat an id are captures of their own; those that repeat the smallest id of a payload are
    responses too.

    A record id is made of id, url, payload digest, and, for rows equal in all three, a number given by a
    distributed sort of such rows.  Revisits are decided on ids and digests; payloads are not shuffled while at
    most ``SENT_ROWS`` payloads occur several times.  Files are written by size class of the payload, with so many
    captures in one that it holds ``FILE_BYTES`` at most, or one capture.
    """
    scratch = Scratch(pages.sparkSession, "warc-ids")
    payload = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col(id_col).alias("id"), _clean(F.col("url")).alias("url"), payload.alias("html"))
    named = named.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "bytes": F.octet_length("html"), "place": F.xxhash64("url")})
    ids = scratch.table(named.select("id", "digest", "bytes", "place"), "ids")
    same = ["id", "digest", "place"]
    # equal payloads and equal rows are counted on the map side
    held = F.when(F.col("id").isNotNull(), F.struct("id", "place"))
    firsts = ids.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min(held).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = scratch.table(firsts.where("n > 1 and first is not null").select("digest", F.col("first.id").alias("first"), F.col("first.place").alias("first_place")), "firsts")
    repeated = scratch.table(ids.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    classes = [r["c"] for r in ids.select(_size_class(F.col("bytes")).alias("c")).distinct().collect()]  # a row per class
    if repeated.isEmpty():
        rows = named.withColumn("copy", F.lit(0).cast("bigint"))
    else:
        twin = repeated.select(*[F.col(c).alias(f"__{c}") for c in same])
        equal = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
        alike = equal[0] & equal[1] & equal[2]
        single = named.join(twin, alike, "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
        numbered, _ = number_rows(named.join(twin, alike, "left_semi"), same, "number", scratch)
        start = numbered.groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.min("number").alias("start"))
        several = numbered.join(start, alike).withColumn("copy", F.col("number") - F.col("start"))
        rows = single.unionByName(several.select(single.columns))
    rows = kept_by(rows, firsts, ["digest"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("bytes") >= MIN_REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    me, request, meta = (_urn(kind, *[F.col(c) for c in (*same, "copy")]) for kind in ("response", "request", "metadata"))
    origin = _urn("response", F.col("first"), F.col("digest"), F.col("first_place"), F.lit(0))
    length = F.col("bytes").cast("string")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", me),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, origin)),
            ("WARC-Profile", F.when(revisit, F.lit(profile))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}"))
    requested = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/http; msgtype=request"))],
        asked,
    )
    fields = F.concat(
        F.coalesce(F.concat(F.lit("captureId: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.coalesce(F.concat(F.lit("firstCaptureId: "), F.when(revisit, F.col("first").cast("string")), F.lit(CRLF)), F.lit("")),
        F.lit("payloadBytes: "),
        length,
        F.lit(CRLF),
    )
    described = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), *common, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    # the three records of a capture stay in one file: the next to last byte of each but the last is added here
    lines = F.concat(requested, F.lit("\n"), response, F.lit("\n"), described)
    for c in sorted(classes) or [0]:
        most = max(1, FILE_BYTES // (CLASS_BYTES[c] + RECORD_BYTES)) if c < len(CLASS_BYTES) else 1
        own = rows.where(_size_class(F.col("bytes")) == c).select(lines.alias("value"))
        own.write.option("lineSep", "\n").option("maxRecordsPerFile", most).text(f"{path}/size-{c}")


def _size_class(size: Column) -> Column:
    """Number of the first of ``CLASS_BYTES`` that holds a payload, or one more."""
    found = F.lit(len(CLASS_BYTES))
    for c, most in reversed(list(enumerate(CLASS_BYTES))):
        found = F.when(size <= most, c).otherwise(found)
    return found


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive file, by their Content-Length; a broken tail raises ValueError."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].split(b"\r\n")[1:]
        fields = {k.decode().strip(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield {"fields": fields, "block": block}
        at = stop + 8 + size


def _row(record: dict, with_content: bool) -> dict:
    import hashlib

    fields, block = record["fields"], record["block"]
    kind = fields.get("WARC-Type")
    row = {
        "record_id": fields.get("WARC-Record-ID"),
        "warc_type": kind,
        "target_uri": fields.get("WARC-Target-URI"),
        "concurrent_to": fields.get("WARC-Concurrent-To"),
        "refers_to": fields.get("WARC-Refers-To"),
        "payload_digest": (fields.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None,
        "payload_bytes": None,
        "fields": None,
        "content": None,
    }
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = hashlib.sha256(payload).hexdigest()
        if row["payload_digest"] not in (None, found):
            raise ValueError(f"the payload of {row['record_id']} does not match its digest")
        row |= {"payload_digest": found, "payload_bytes": len(payload), "content": payload if with_content else None}
    elif kind == "metadata":
        pairs = [x.partition(b":") for x in block.split(b"\r\n") if x]
        row["fields"] = [(k.decode().strip(), v.decode("utf-8", "replace").strip()) for k, _, v in pairs]
    return row


def read_records(spark: SparkSession, path: str, *, with_content: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; digests of responses are checked."""
    prepare_python(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for record in parse_records(data.as_py()):
                    rows.append(_row(record, with_content))
                    held += len(rows[-1]["content"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    from pyspark.sql.pandas.types import from_arrow_schema

    return files.select("content").mapInArrow(parse, from_arrow_schema(RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata, joined by record id.

    A capture is named by its response's or revisit's record id.  A missing request or metadata record
    leaves its struct null; requests that name no capture in the table keep a row without response.
    """
    own = F.col("warc_type").isin("response", "revisit")
    capture = F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to"))

    def one(test: Column, *cols: str) -> Column:
        return F.first(F.when(test, F.struct(*cols)), ignorenulls=True)

    held = ["record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "content"]
    return (
        records.withColumn("capture_id", capture)
        .groupBy("capture_id")
        .agg(
            one(F.col("warc_type") == "request", "record_id", "target_uri").alias("request"),
            one(F.col("warc_type") == "response", *held).alias("response"),
            one(F.col("warc_type") == "revisit", *held).alias("revisit"),
            one(F.col("warc_type") == "metadata", "record_id", "fields").alias("metadata"),
        )
    )


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and describe each capture."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write_captures(pages, path)
    captures = assemble(read_records(pages.sparkSession, path, with_content=False))
    answer = F.coalesce("response", "revisit")
    fields = F.col("metadata.fields")
    return captures.select(
        fields["captureId"].cast("bigint").alias("page_id"),
        F.coalesce(answer["payload_bytes"], fields["payloadBytes"].cast("bigint")).alias("payload_bytes"),
        answer["payload_digest"].alias("payload_digest"),
        F.when(F.col("revisit").isNotNull(), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        fields["firstCaptureId"].cast("bigint").alias("refers_to"),
    )
