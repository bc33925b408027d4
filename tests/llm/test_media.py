import hashlib
import io
import tarfile
import zlib

from scrubjay.llm import media_tar
from scrubjay.llm.shared import file_system


def test_png_round_trip():
    for data in (b"", b"x", b"\xff" * 576, "é".encode() * 1000, bytes(range(256)) * 9):
        payload = media_tar.padded(data)
        assert len(payload) % 576 == 0 and payload and payload.startswith(data)
        image = media_tar.to_png(payload)
        assert media_tar.from_png(image) == payload and media_tar.header_of(image[:33]) == (576, len(payload) // 576, 8)


def test_rows_shards_and_features(spark, odd_docs, no_docs, scratch_dir):
    rows = media_tar.media_columns(odd_docs, f"{scratch_dir}/m1").collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        data = (texts[r.doc_id] or "").encode()
        payload = media_tar.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == r.digest and r.height == len(payload) // 576
        system, path = file_system(r.shard)
        with system.open_input_file(path) as f:
            assert hashlib.sha256(f.read_at(r.length, r.offset)).hexdigest() == r.digest
            f.seek(0)
            names = tarfile.open(fileobj=io.BytesIO(f.read())).getnames()
        assert f"{r.digest}.png" in names and len(names) == len(set(names))
    assert len({(r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})
    assert media_tar.media_columns(no_docs, f"{scratch_dir}/m2").count() == 0


def test_metadata_reads_headers_only(spark, odd_docs, scratch_dir, monkeypatch):
    places = media_tar.canonical(media_tar.store(odd_docs, f"{scratch_dir}/m3", shard_bytes=1000)).cache()
    seen = {r.digest: (r.width, r.height, r.bits) for r in media_tar.metadata(places).collect()}
    assert len(seen) == places.count() and {s[0] for s in seen.values()} == {576}
    read = []
    monkeypatch.setattr(media_tar.Reader, "read", lambda self, s, o, n: read.append(n) or media_tar.to_png(media_tar.padded(b""))[:n])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"shard": ["s"], "offset": [512], "length": [10_000], "digest": ["d"]})
    [media_tar.header_of(media_tar.Reader().read("s", 512, min(n, media_tar.HEADER_BYTES))) for n in batch.column(2).to_pylist()]
    assert read == [33]
