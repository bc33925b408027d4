import itertools
import zlib

import numpy as np
import pytest

from scrubjay.llm import langid, queries

SMALL = langid.Settings(sample_docs=8, sample_words=4000, epochs=12, buckets_log2=12)
WORDS = {"aa": "kalo mira selo tuna pare".split(), "bb": "xyth wrog zzek qurt vlix".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    pairs = [(text(rng, lang, 30), lang) for lang in ("aa", "bb") for _ in range(20)]
    return langid.fit(*map(list, zip(*pairs)), SMALL)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 1, 3])
    starts = np.array([0, 4, 5])
    scores, transitions = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, total, pairs = langid.forward_backward(scores, starts, lengths, transitions, pairs=True)
    want_total, want_pairs = 0.0, np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = np.array([np.exp(sum(scores[s + k, y] for k, y in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        want_total += np.log(weights.sum())
        for k in range(n):
            for y in range(3):
                assert got[s + k, y] == pytest.approx(weights[[p[k] == y for p in paths]].sum() / weights.sum())
        for p, w in zip(paths, weights / weights.sum()):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert total == pytest.approx(want_total) and np.allclose(pairs, want_pairs)


def test_words_of_mixed_text(spark, model):
    rows = spark.createDataFrame([(1, "kalo mira selo tuna. xyth wrog zzek qurt vlix 12 kalo tuna pare mira")], "doc_id long, text string")
    labels = [r.label for r in langid.label_words(rows, model).orderBy("position").collect()]
    assert labels == ["aa"] * 4 + ["bb"] * 5 + ["und"] + ["aa"] * 4


def test_odd_rows(odd_docs, no_docs, model):
    rows = langid.predict(odd_docs, model).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None:
            lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") != lettered and (r.score > 0) == lettered
    assert langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert set(langid.train(odd_docs, SMALL).labels) == {"en", "fr"}


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_crf_language(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_edges_do_not_outvote_a_text(spark, model):
    """300 words between two words of the other language at each end are what they are, with a score near their share."""
    rng = np.random.default_rng(5)
    inner = text(rng, "bb", 300)
    rows = spark.createDataFrame([(1, f"kalo mira. {inner} selo tuna.")], "doc_id long, text string")
    found = langid.predict(rows, model).first()
    assert found.lang_pred == "bb" and found.score == pytest.approx(300 / 304, abs=0.02)


def test_document_labels_equal_enumeration(model):
    """A text's label and score beside marginals from all label paths of each of its sentences."""
    texts = ["kalo mira xyth. wrog 12 selo?", "zzek", "kalo tuna. mira qurt vlix! selo", "?!", ""]
    rows, codes, marginals, lettered, words = langid.labelled(langid.pa.array(texts), model)
    score = langid.emissions(words, model.weights, model.lexicon, model.settings)[codes].astype(float)
    best, share, counts = langid.document_labels(rows, marginals, lettered)
    spelled = words.take(langid.pa.array(codes)).to_pylist()
    for t in range(len(texts)):
        votes, sentence = [], []
        for k in range(rows[t], rows[t + 1]):
            sentence.append(k)
            if spelled[k][-1] in ".!?" or k == rows[t + 1] - 1:
                paths = list(itertools.product(range(2), repeat=len(sentence)))
                weights = np.array([np.exp(sum(score[i, y] for i, y in zip(sentence, p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:]))) for p in paths])
                votes += [[weights[[p[j] == y for p in paths]].sum() / weights.sum() for y in range(2)] for j, i in enumerate(sentence) if lettered[i]]
                sentence = []
        assert counts[t] == len(votes)
        if votes:
            want = np.mean(votes, axis=0)
            assert best[t] == want.argmax() and share[t] == pytest.approx(want.max(), abs=1e-3)


@pytest.mark.parametrize("lengths,budget", [([5, 1, 9], 30), ([5, 1, 9], 10), ([100], 7), ([3, 3, 3], 9), ([3, 3, 4], 9), ([], 5)])
def test_fair_share(lengths, budget):
    cap = langid.fair_share(lengths, budget)
    taken = lambda c: sum(min(n, c) for n in lengths)
    assert taken(cap) <= budget and (taken(cap) == sum(lengths) or taken(cap + 1) > budget)
