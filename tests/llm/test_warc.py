import base64
import gzip
import hashlib
import zlib

import pytest

from scrubjay.llm import warc
from scrubjay.llm.shared import file_system, publish

SCHEMA = "page_id long, url string, html string, payload string, sha1 string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_records_round_trip(spark, scratch_dir):
    texts = ["<p>a</p>", None, "", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "<p>a</p>", "x" * 300_000, "é\r\n\r\né", "<p>a</p>"]
    rows = [(i, [None, "http://h/\r\nx y", "u"][i % 3], t, "p", "s") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, SCHEMA)
    manifest, files = warc.archive(spark, pages, f"{scratch_dir}/w1")
    got = {int(r.record_id): r for r in warc.read_indexed(manifest, files).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        last = max(k for k, t in enumerate(texts) if (t or "") == (text or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((text or "").encode()), digest(text))
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", str(last)))
        assert (bytes(r.payload) if i == last else r.payload) == ((text or "").encode() if i == last else None)


def test_members_are_single_records_and_the_index_finds_them(spark, scratch_dir):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50, "p", "s") for i in range(20)], SCHEMA)
    manifest, _ = warc.archive(spark, pages, f"{scratch_dir}/w2")
    for row in manifest.collect():
        system, path = file_system(row.archive)
        with system.open_input_file(path) as f:
            data, at = f.read(), 0
        index = warc.read_index(row.archive)
        assert len(index) == row.records
        for offset, length, kind, _ in index:
            assert offset == at and kind == "response"
            d = zlib.decompressobj(31)
            assert d.decompress(data[offset : offset + length]).startswith(b"WARC/1.1") and d.eof and not d.unused_data
            at += length
        assert at == len(data)


def test_rows_that_repeat_and_null_ids(spark, scratch_dir):
    pages = spark.createDataFrame([(3, "u", "same", "", ""), (3, "u", "same", "", ""), (1, "u", "same", "", ""), (None, "u", "same", "", ""), (None, None, "other", "", "")], SCHEMA)
    manifest, files = warc.archive(spark, pages, f"{scratch_dir}/w3")
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "") for r in warc.read_indexed(manifest, files).collect())
    assert got == [("", "response", ""), ("", "revisit", "3"), ("1", "revisit", "3"), ("3", "response", ""), ("3", "response", "")]
    manifest, files = warc.archive(spark, pages.limit(0), f"{scratch_dir}/w4")
    assert warc.read_indexed(manifest, files).count() == 0


def test_damaged_archives_are_errors(spark, scratch_dir):
    from pyspark.errors import PythonException

    good = warc.record("1", "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, True)
    for k, data in enumerate((gzip.compress(good[:-12]), gzip.compress(good)[:-9], gzip.compress(b"nonsense\r\n"))):
        name = f"{scratch_dir}/bad{k}.warc.gz"
        publish(name, data)
        with pytest.raises(PythonException):
            warc.normalise(spark.createDataFrame([(name, 1)], "archive string, records long"), f"{scratch_dir}/badout", 1).collect()
