import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from scrubjay.llm import packing, queries

PATH = P.path("word_bpe_49k.json")


def by_library(text):
    return packing.tokenizer_of(PATH).encode(text or "", add_special_tokens=False).ids


def check(pieces, texts):
    """Every id of every document in exactly one piece; sequences gapless and within capacity."""
    docs, sequences = {}, {}
    for r in pieces:
        assert r.length == len(bytes(r.ids)) // 4
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        want = np.array([*by_library(text), 2], "<u4").tobytes()
        got = sorted(docs[doc], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == want and [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1].tolist()]
        assert {r.doc_tokens for r in got} == {len(want) // 4}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


def test_words_as_the_library_tokenises_them():
    words = ["The", "the,", "it's", "x's,", "ÉTÉ!!", "ß%%%", "a.b,", "…", "wait…", "3,", "12a", "日本", "İx", "e\u0301a", "<|endoftext|>", "a<|endoftext|>b", "''", "'s", "don't", "a\u00a0b", "\u2028", "x" * 300, "|", "ǅ", "a_b_", "(c)", "Ωμ.", "don'", "ſt"]
    ids, offsets = packing.WordIds(PATH)(pa.array(words))
    for k, word in enumerate(words):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == by_library(word), word


def test_first_fit_decreasing_equals_a_plain_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 300, size=rng.integers(1, 60)).tolist()
        rest, plain = sorted(((n % 100, d) for d, n in enumerate(lengths) if n % 100), key=lambda r: (-r[0], r[1])), []
        for n, _ in rest:
            k = next((i for i, free in enumerate(plain) if free >= n), len(plain))
            plain += [100] * (k == len(plain))
            plain[k] -= n
        pieces = packing.pack_lengths(lengths, 100)
        assert len({p[3] for p in pieces}) == len(plain) + sum(n // 100 for n in lengths)
        assert sum(p[2] for p in pieces) == sum(lengths)


def test_odd_rows(odd_docs, no_docs):
    settings = packing.Settings(PATH, group_tokens=3000)
    pieces = packing.pack(odd_docs, settings).collect()
    assert len({(r.doc_id, r.start, r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(by_library(r.text)) + 1) for r in odd_docs.collect())
    got = {}
    for r in pieces:
        if r.start == 0:
            got.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r.doc_tokens)
    assert sorted((*k, n) for k, ns in got.items() for n in ns) == want
    assert sum(r.length for r in pieces) == sum(n for *_, n in want)
    assert packing.pack(no_docs, settings).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences = check(packing.pack(docs, packing.Settings(PATH)).collect(), texts)
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert total / (4096 * len(sequences)) > 0.9
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op5_ffd_packing(spark, sf_dir).collect() if r.start == 0 and r.length == r.doc_tokens}
    doc = next(iter(digests))[0]
    assert digests[(doc, 0)] == zlib.crc32(np.array([*by_library(texts[doc]), 2], "<u4").tobytes())
