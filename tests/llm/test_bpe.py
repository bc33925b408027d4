import numpy as np
import public_tokenizers as P
import pytest

from scrubjay.llm import bpe, queries

VOCABULARY = bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
SMALL = VOCABULARY._replace(chunk_chars=120, overlap_chars=24)


def whole(text):
    return np.array(bpe.encoding_of(VOCABULARY.ranks_path, P.PATTERN).encode_ordinary(text or ""), "<u4")


def chunked(text, chunk, overlap):
    pattern, pieces = bpe.pattern_of(P.PATTERN), bpe.Pieces(VOCABULARY)
    parts = [(s, t, *bpe.encode_chunk(t, s, pattern, pieces)) for s, t in bpe.cut(text, chunk, overlap)]
    return bpe.stitch(parts, pattern, pieces)


@pytest.mark.parametrize("text", ["x" * 900 + " y", "a  b\t\t" * 90, " " * 700, "it's we're 'll" * 60, "", "ß" * 333 + "\n\n \n" * 70, "12 345  678\n" * 40, "!?.. " * 100, "a" * 119 + " " * 3 + "b" * 200])
@pytest.mark.parametrize("chunk,overlap", [(50, 8), (64, 32), (119, 5), (1000, 100)])
def test_stitched_chunks_equal_the_whole(text, chunk, overlap):
    assert chunked(text, chunk, overlap).tolist() == whole(text).tolist()


def test_random_texts_stitch():
    rng = np.random.default_rng(3)
    alphabet = list("ab  \n\t'sé1.🙂")
    for _ in range(300):
        text = "".join(rng.choice(alphabet, size=rng.integers(0, 300)))
        assert chunked(text, int(rng.integers(20, 80)), int(rng.integers(5, 20))).tolist() == whole(text).tolist()


def test_odd_rows_round_trip(odd_docs, no_docs):
    for vocabulary in (VOCABULARY, SMALL):
        ids = bpe.encode(odd_docs, vocabulary)
        raw = bpe.decode(ids, vocabulary)
        given = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd_docs.collect())
        assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.bytes).decode()) for r in raw.collect()) == given
        assert sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect()) == [(a, b, whole(t).tolist()) for a, b, t in given]
        assert bpe.encode(no_docs, vocabulary).count() == 0 and bpe.decode(bpe.encode(no_docs, vocabulary), vocabulary).count() == 0


def test_query_beside_the_library(spark, sf_dir):
    """Every value of the query beside the library's own encoding of the whole text."""
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, sf_dir).collect():
        ids = whole(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_query_columns(spark, sf_dir):
    rows = queries.op2_byte_bpe(spark, sf_dir)
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(rows.dtypes)["n_tokens"] == "bigint"
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
