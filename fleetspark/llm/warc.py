"""Operator 3: WARC archives with revisit resolution.

``plan_records`` shuffles only headers (page id, payload size and digest) by payload
digest: an aggregation finds, for each digest that repeats, the original response,
and a join hands every other record of it a reference.  These references, as many as
there are revisits, go back to the pages by page id and digest, so a digest that a third
of the pages share gathers no payloads.  ``write_warc``
then writes one WARC/1.1 record a page with fresh headers - a full ``response``
or a bodiless ``revisit`` - through Spark's text writer, so it works on any
file system Spark writes to and a lost executor's file is written again.
``read_warc`` streams the gzipped archives back by Content-Length and checks
each response's digest; ``resolve`` joins revisit records to their responses.

Defined results: a null ``html`` is an empty payload; a null ``url`` gives a record
without target URI; blanks and control characters in a URL are percent-escaped.
Among equal payloads of at least ``min_bytes`` the largest ``page_id`` (nulls
smallest) is the response.  Rows that repeat a response's ``page_id`` and payload
are the same record and stay responses.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.common import scratch, written

WARC_DATE = "2024-01-01T00:00:00Z"
INDEX_SCHEMA = ("page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, "
                "target_uri string, refers_to_id string, refers_to long")
#: The record layout of WARC/1.1.
VERSION, CRLF, END = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("payload_digest"))


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Headers and payload of each page with ``record_type`` and ``refers_to``."""
    heads = headers(pages)
    payload = ["payload_digest", "payload_bytes"]
    large = written(heads.where(F.col("payload_bytes") >= min_bytes).select("page_id", *payload), "headers")
    originals = (large.groupBy(*payload).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
                 .where("copies > 1 AND refers_to IS NOT NULL").drop("copies"))
    # the digest is in the key: rows without a page id are not one key
    revisits = written(
        large.join(originals, payload).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest"), "refers_to").distinct(), "revisits")
    again = (heads["payload_digest"] == F.col("of_digest")) & heads["page_id"].eqNullSafe(F.col("of_page"))
    found = heads.join(revisits, again & (heads["payload_bytes"] >= min_bytes), "left")
    return (found.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
            .select(*payload, "page_id", "url", "payload", "record_type", "refers_to"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4),
                    F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))


def record_text(date: str = WARC_DATE) -> Column:
    """The whole record of a planned row, without the two line ends that follow it."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    c = F.col
    revisit = c("record_type") == "revisit"
    url = F.regexp_replace(c("url"), "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    c("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(c("payload").cast("string"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(c("payload_bytes"))
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"), line("WARC-Type", c("record_type")),
        line("WARC-Record-ID", _record_id(c("page_id"), c("payload_digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("X-Page-Id", c("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(c("refers_to"), c("payload_digest")))),
        line("X-Refers-To-Page-Id", c("refers_to").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit(CRLF), http, body)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = WARC_DATE) -> None:
    """Write the deduplicated archives (gzip) of ``pages`` (``page_id``, ``url``, ``html``)."""
    (plan_records(pages, min_bytes).select(record_text(date).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(path))


class _Stream:
    """Records out of the byte stream of one archive, which arrives in blocks between separators."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = self.need = 0
        self.begun = False

    def feed(self, block: bytes):
        """Add a block (and the separator before it); yield (header fields, block bytes) of each whole record."""
        if self.begun:
            block = END.encode() + block
        self.begun = True
        self.parts.append(block)
        self.size += len(block)
        if self.size >= self.need:
            yield from self._records()

    def finish(self):
        """The file has ended, with a separator or with bytes that end in one."""
        if self.begun:
            self.parts.append(END.encode())
            self.size += len(END)
            yield from self._records()
            if b"".join(self.parts).strip(b"\r\n"):
                raise ValueError("an archive ends within a record")
        self.__init__()

    def _records(self):
        data = b"".join(self.parts)
        while True:
            head_end = data.find(END.encode())
            if head_end <= 0:
                self.need = 0
                break
            lines = data[:head_end].decode().split(CRLF)
            if lines[0] != VERSION:
                raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            begin = head_end + len(END)
            end = begin + int(fields["Content-Length"])
            if len(data) < end + len(END):
                self.need = end + len(END)
                break
            if data[end:end + len(END)] != END.encode():
                raise ValueError("a record does not end where its Content-Length says")
            yield fields, data[begin:end]
            data = data[end + len(END):]
        self.parts, self.size = ([data], len(data)) if data else ([], 0)


def _parse(batches):
    stream, current = _Stream(), None
    for batch in batches:
        rows = []
        for path, value in zip(batch.column("file"), batch.column("value"), strict=True):
            path = path.as_py()
            if path != current:
                rows += [_index_row(fields, block) for fields, block in stream.finish()]
                current = path
            rows += [_index_row(fields, block) for fields, block in stream.feed(value.as_py())]
        yield _index_batch(rows)
    yield _index_batch([_index_row(fields, block) for fields, block in stream.finish()])


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in INDEX_SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)


def _index_row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = None
    if fields["WARC-Type"] == "response":
        payload = block[block.index(END.encode()) + len(END):]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return (number("X-Page-Id"), fields["WARC-Record-ID"], fields["WARC-Type"], digest, size,
            fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), number("X-Refers-To-Page-Id"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index of the archives' records; a gzipped archive is one stream, read by one task in file order."""
    lines = spark.read.option("lineSep", END).text(path)
    return (lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
            .mapInArrow(_parse, INDEX_SCHEMA))


def resolve(index: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to; a revisit takes its size from there."""
    index = written(index, "warc-index")
    revisits = index.where("record_type = 'revisit'").drop("payload_bytes")
    responses = index.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_id"), "payload_digest", "payload_bytes").distinct()
    resolved = revisits.join(written(targets.join(revisits.select("refers_to_id").distinct(), "refers_to_id"), "targets"),
                             ["refers_to_id", "payload_digest"], "left")
    return responses.unionByName(resolved).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri")


def archive(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, min_bytes)
    return resolve(read_warc(spark, path))
