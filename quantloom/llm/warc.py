"""WARC archives as chunked record tables.

Writing: every payload goes out as WARC/1.1 records of at most `chunk_bytes` of payload; a longer one is segmented, its
first record followed by continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, WARC-Segment-Total-Length).
So one row of the record table is (record identifier, chunk number, block), and no block is longer than a chunk. The text
sink writes the rows, CR LF CR LF being both its line separator and what ends a WARC record; files are gzip, so that one
task reads a file whole and in order. Equal payloads are stored once; the others are revisit records that name it.

Reading: the file comes in pieces and a small state machine cuts records by Content-Length and yields the chunk table
(record_id, chunk_no, chunk, digest state), the SHA-1 carried on from chunk to chunk. Nothing holds a record whole. The
digest found must be the one in the record's header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

CHUNK_BYTES = 1 << 20
_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(payload_bytes=[len(p) for p in b["payload"]], payload_digest=[base32_sha1(hashlib.sha1(p).digest()) for p in b["payload"]])


def record_id(page_id, origin: str, n: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}/{page_id}/{n}')}>"


def _header(**fields) -> str:
    return "\r\n".join(["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None)]) + "\r\n\r\n"


def _records(chunk_bytes: int, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for page, url, payload, size, digest, response in zip(b["page_id"], b["url"], b["payload"], b["payload_bytes"], b["payload_digest"], b["response_id"], strict=True):
                uri = None if not isinstance(url, str) else "".join(c for c in url if c >= " ")
                same = {"WARC_Date": date, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_Id": page, "X_Payload_Length": int(size)}
                if response != page:
                    out.append(_header(WARC_Type="revisit", WARC_Record_ID=record_id(page, "page"), **same, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=record_id(response, "page"), X_Refers_To_Page=response, Content_Length=0).encode())
                    continue
                http, parts = _HTTP.format(int(size)).encode(), max(1, -(-len(payload) // chunk_bytes))
                view = memoryview(payload)
                for n in range(1, parts + 1):
                    block = bytes(view[(n - 1) * chunk_bytes : n * chunk_bytes])
                    if n == 1:
                        block = http + block
                        head = _header(WARC_Type="response", WARC_Record_ID=record_id(page, "page"), **same, WARC_Segment_Number=1 if parts > 1 else None, Content_Type="application/http; msgtype=response", Content_Length=len(block))
                    else:
                        head = _header(WARC_Type="continuation", WARC_Record_ID=record_id(page, "page", n), WARC_Date=date, WARC_Segment_Origin_ID=record_id(page, "page"), WARC_Segment_Number=n, WARC_Segment_Total_Length=len(payload) + len(http) if n == parts else None, Content_Length=len(block))
                    out.append(head.encode() + block)
                    held += len(block)
                    if held > 8 * chunk_bytes:
                        yield pd.DataFrame({"record": out})
                        out, held = [], 0
            if out:
                yield pd.DataFrame({"record": out})

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """pages(page_id, url, html) -> gzip WARC files under path. Payload: html in UTF-8, empty if null.

    Of records with equal payloads of at least least_bytes, the one with the smallest page_id is a response and the
    others are revisits of it; shorter payloads are responses all. Rows that repeat a page_id and its payload are written
    alike, each of them; a null page_id is written without identifier and revisits if it can. Other columns are ignored.
    Identifiers pass through Python as decimal text, for pandas would turn a batch with a null into doubles.
    """
    own = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    shape = "page_id string, url string, payload binary, payload_bytes long, payload_digest string"
    named = own.mapInPandas(_digests, shape)
    heads = own.drop("url").withColumn("url", F.lit(None).cast("string")).select("page_id", "url", "payload").mapInPandas(_digests, shape)
    heads = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(F.col("page_id").cast("long")).cast("string").alias("response_id"))
    # Written first: a join right above an aggregation has no shuffle of its own that Spark could split at a hot payload.
    ruled = named.join(materialize(heads, "warc-heads"), ["payload_digest", "payload_bytes"], "left")
    # The text of a revisit is not needed any more.
    ruled = ruled.withColumn("response_id", F.coalesce("response_id", "page_id")).select("page_id", "url", F.when(F.col("page_id").eqNullSafe(F.col("response_id")), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "payload_bytes", "payload_digest", "response_id")
    rows = ruled.mapInPandas(_records(chunk_bytes, date), "record binary")
    rows.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


class RecordReader:
    """Cuts a byte stream into WARC records and hands their blocks on piece by piece: (headers, piece, last piece?)."""

    def __init__(self):
        self.buffer, self.headers, self.left = bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        self.buffer += data
        while True:
            if self.headers is None:
                while self.buffer[:2] == b"\r\n":
                    del self.buffer[:2]
                end = self.buffer.find(_END)
                if end < 0:
                    return
                lines = self.buffer[:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record where one should start: {lines[0][:60]!r}")
                self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if "content-length" not in self.headers:
                    raise ValueError("a WARC record without Content-Length")
                self.left = int(self.headers["content-length"])
                del self.buffer[: end + 4]
                if not self.left:
                    yield self.headers, b"", True
                    self.headers = None
                    continue
            if not self.buffer:
                return
            piece = bytes(self.buffer[: self.left])
            del self.buffer[: len(piece)]
            self.left -= len(piece)
            yield self.headers, piece, not self.left
            if not self.left:
                self.headers = None


def _read(chunk_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, sha, origin, chunk, body, http, rest = RecordReader(), None, None, 0, 0, b"", bytearray()

        def row(data: bytes, whole: bool):
            nonlocal chunk, body
            sha.update(data)
            chunk, body = chunk + 1, body + len(data)
            digest = base32_sha1(sha.digest()) if whole else sha.hexdigest()
            if whole and (f"sha1:{digest}" != origin["warc-payload-digest"] or body != int(origin["x-payload-length"])):
                raise ValueError(f"record {origin['warc-record-id']}: its payload is not the one that was written")
            return origin.get("x-page-id"), "response", None, chunk, data, whole, body, digest

        for b in batches:
            out = []
            for value in b["value"]:
                for h, piece, last in reader.feed(bytes(value) + _END):
                    kind = h["warc-type"]
                    if kind == "revisit":
                        out.append((h.get("x-page-id"), "revisit", h.get("x-refers-to-page"), 1, b"", True, int(h["x-payload-length"]), h["warc-payload-digest"][5:]))
                        continue
                    if kind == "response" and origin is not h:
                        sha, origin, chunk, body, http, rest = hashlib.sha1(), h, 0, 0, b"", bytearray()
                    if http is not None:  # still before the payload
                        http += piece
                        at = http.find(_END)
                        if at < 0:
                            continue
                        piece, http = http[at + 4 :], None
                    rest += piece
                    while len(rest) > chunk_bytes:
                        out.append(row(bytes(rest[:chunk_bytes]), False))
                        del rest[:chunk_bytes]
                    if last and (kind == "response" and "warc-segment-number" not in h or "warc-segment-total-length" in h):
                        out.append(row(bytes(rest), True))
                        rest = bytearray()
            if out:
                yield pd.DataFrame(out, columns=["page_id", "record_type", "refers_to", "chunk_no", "chunk", "complete", "bytes_so_far", "digest_so_far"])
        if reader.headers is not None or bytes(reader.buffer).strip() or rest:
            raise ValueError("the archive ends within a record")

    return run


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives under path: page_id, record_type, refers_to, chunk_no (from 1), chunk, complete,
    bytes_so_far, digest_so_far (hexadecimal state; of a complete record its base32 SHA-1). A revisit has one empty chunk
    with the figures of the payload that it refers to."""
    pieces = spark.read.option("lineSep", _END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    rows = pieces.mapInPandas(_read(chunk_bytes), "page_id string, record_type string, refers_to string, chunk_no long, chunk binary, complete boolean, bytes_so_far long, digest_so_far string")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and list what they hold: page_id, payload_bytes, payload_digest,
    record_type, refers_to; one row for each row of pages."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    back = read_chunks(pages.sparkSession, path).where("complete")
    return back.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
