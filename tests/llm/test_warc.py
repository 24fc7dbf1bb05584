import base64
import glob
import gzip
import hashlib
import os
import uuid

import pytest

from quantloom.llm.common import shared_dir
from quantloom.llm.warc import RecordReader, read_chunks, round_trip, write_archives

PAGES = [
    (5, "http://a/\r\nX: y", "same", 1), (2, "http://b", "same", 2), (9, None, "same", 3), (3, "http://c", None, 4), (4, "http://d", "", 5),
    (6, "http://e", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 6), (7, "http://f", "ends in a line\r\n", 7), (8, "http://g", "é" * 5000 + "\r\n\r\n", 8), (10, "u", "\r\n\r\n\r\n", 9),
]


def expected():
    first = {}
    for i, _, h, _ in PAGES:
        first[h or ""] = min(i, first.get(h or "", i))
    out = {}
    for i, _, h, _ in PAGES:
        b = (h or "").encode()
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
    return out


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_digest int")


def test_round_trip(spark):
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in round_trip(pages(spark)).collect()}
    assert got == expected()


def test_segments_are_bounded_and_join_to_the_payload(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    write_archives(pages(spark), path, chunk_bytes=1000)
    rows = read_chunks(spark, path, 700).where("record_type = 'response'").orderBy("page_id", "chunk_no").collect()
    assert max(len(r["chunk"]) for r in rows) == 700
    text = {}
    for r in rows:
        text[r["page_id"]] = text.get(r["page_id"], b"") + bytes(r["chunk"])
    assert text == {i: (h or "").encode() for i, _, h, _ in PAGES if expected()[i][2] == "response"}
    assert sum(r["complete"] for r in rows) == len(text)
    # The files are WARC: a reader that knows nothing of Spark finds every record by its Content-Length.
    found = 0
    for f in glob.glob(path.removeprefix("file:").replace("//", "/") + "/*.gz"):
        for _, _, last in RecordReader().feed(gzip.open(f).read()):
            found += last
    assert found == sum(max(1, -(-n // 1000)) if kind == "response" else 1 for n, _, kind, _ in expected().values())


def test_a_record_that_is_cut_off_is_an_error(spark):
    path = f"{shared_dir(spark)}/warc-cut-{uuid.uuid4().hex}"
    write_archives(pages(spark).where("page_id = 8").coalesce(1), path)
    local = path.removeprefix("file:").replace("//", "/")
    data = b"".join(gzip.open(f).read() for f in glob.glob(local + "/*.gz"))
    assert len(data) > 10_000
    os.makedirs(local + "-cut")
    with gzip.open(local + "-cut/part-0.txt.gz", "wb") as f:
        f.write(data[:-60])
    with pytest.raises(Exception, match="ends within a record"):
        read_chunks(spark, path + "-cut").collect()


def test_least_bytes_and_empty(spark):
    path = f"{shared_dir(spark)}/warc-least-{uuid.uuid4().hex}"
    write_archives(pages(spark), path, least_bytes=5)
    assert read_chunks(spark, path).where("record_type = 'revisit'").count() == 0
    assert round_trip(pages(spark).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, None, "a"), (1, None, "a")], "page_id long, url string, html string")
    assert sorted(str(r["page_id"]) for r in round_trip(odd).collect()) == ["1", "1", "None"]
