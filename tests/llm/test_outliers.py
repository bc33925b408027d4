import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubjay.llm import robust_outliers as ro

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_a_plain_reading(spark, odd_docs):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab  \n\t#|é\x0b "), size=rng.integers(0, 120))) for _ in range(300)] + [r.text for r in odd_docs.collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", ro.statistics(F.col("t")).alias("s")).select("i", "s.*")
    for r in df.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.i]), texts[r.i]


def scatter(x, settings):
    return settings.consistency * np.cov(x.T, bias=True) + np.diag(np.square(settings.floors))


def test_least_determinant_beside_all_subsets(spark, scratch_dir):
    """Small groups: the subset found is that of the least determinant among all subsets of its size."""
    settings = ro.Settings()
    groups, rng = {}, np.random.default_rng(21)
    for g in range(8):
        x = rng.normal(size=(12, 4)) @ (np.eye(4) * 0.4 + 0.2 * rng.normal(size=(4, 4)))
        x[:3] += rng.normal(size=4) * 4 if g % 2 else rng.normal(size=(3, 4)) * 6  # three outliers, in a cluster or scattered
        groups[f"g{g}"] = x
    groups["same"] = np.tile([0.3, 0.0, 0.0, 0.5], (12, 1))
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "pool string, x0 double, x1 double, x2 double, x3 double")
    for small in (True, False):
        got = {r.pool: r for r in ro.least_determinants(rows, settings, f"{scratch_dir}/subsets-{small}", small).collect()}
        assert got.keys() == groups.keys()
        for g, x in groups.items():
            best = min((x[list(c)] for c in itertools.combinations(range(12), 9)), key=lambda y: np.linalg.det(scatter(y, settings)))
            s = scatter(best, settings)
            assert np.allclose([got[g][f"m{i}"] for i in range(4)], best.mean(axis=0), atol=1e-6), g
            assert np.allclose([got[g][f"s{i}{j}"] for i, j in ro.pairs()], [s[i, j] for i, j in ro.pairs()], atol=1e-6), g


def test_steps_never_raise_a_determinant(spark, scratch_dir):
    rng = np.random.default_rng(8)
    settings = ro.Settings()
    x = rng.normal(size=(401, 4)) @ (np.eye(4) * 0.3 + 0.1)
    x[:60] += 5
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "pool string, x0 double, x1 double, x2 double, x3 double").cache()
    now, before = ro.stored(ro.starts(rows, settings, f"{scratch_dir}/steps", True), f"{scratch_dir}/steps/0"), None
    for k in range(1, 7):
        now = ro.stored(ro.concentrated(rows, now, settings), f"{scratch_dir}/steps/{k}")
        dets = {r.start: r.d for r in ro.factored(now).select("start", ro.log_determinant().alias("d")).collect()}
        assert dets.keys() == {0, 1, 2, 3} and (before is None or all(dets[i] <= before[i] + 0.02 for i in dets))  # bins are taken whole
        before = dets
    inner = x[60:]
    best = ro.factored(ro.least_determinants(rows, settings, f"{scratch_dir}/steps/all", True))
    r = best.first()
    assert np.allclose([r[f"m{i}"] for i in range(4)], inner.mean(axis=0), atol=0.1)
    d = rows.crossJoin(best.drop("pool")).select(ro.distance(settings).alias("d")).collect()
    m, s = np.array([r[f"m{i}"] for i in range(4)]), np.zeros((4, 4))
    for i, j in ro.pairs():
        s[i, j] = s[j, i] = r[f"s{i}{j}"]
    assert np.allclose(sorted(q.d for q in d), np.sort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)), rtol=1e-6)


@pytest.mark.parametrize("share", [0.5, 0.75, 0.9, 1.0])
def test_consistency_of_normal_samples(share):
    x = np.random.default_rng(5).normal(size=(200_000, 4))
    d = (x * x).sum(axis=1)
    inner = x[d <= np.quantile(d, share)]
    assert ro.Settings(share=share).consistency == pytest.approx(1 / inner.var(axis=0).mean(), rel=0.01)


def test_odd_rows_and_outliers(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in ro.judge(spark, odd_docs).collect()}
    assert ro.judge(spark, odd_docs).count() == odd_docs.count() and ro.judge(spark, no_docs).count() == 0
    assert not rows[0].kept and rows[0].base_failed and not rows[9].kept and rows[10].kept and rows[8].kept
    kept = ro.keep(spark, odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {8, 10, 100}
    assert ro.keep(spark, no_docs).count() == 0
    rng = np.random.default_rng(1)
    prose = lambda mark: " ".join("".join(rng.choice(list("abcdefghij"), size=rng.integers(2, 9))) + mark for _ in range(120))
    docs = spark.createDataFrame([(i, prose("" if i < 300 else "%%%"), "en", "s") for i in range(310)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in ro.judge(spark, docs).where("NOT kept").collect()} == set(range(300, 310))


def test_only_native_nodes(spark, odd_docs):
    plan = ro.judged(ro.with_statistics(odd_docs, ro.Settings(), "text", "lang", "source"), spark.createDataFrame([], "lang_of string, source_of string, " + ", ".join([f"m{i} double" for i in range(4)] + [f"l{i}{j} double" for i in range(4) for j in range(i + 1)])), ro.Settings())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("texts", [["a b c a b c"], ["x y z"], ["a a a a a"], ["a b"], [""]])
def test_small_windows(spark, texts):
    r = spark.createDataFrame([(t,) for t in texts], "t string").select(ro.statistics(F.col("t")).alias("s")).first().s
    assert r.n_repeat_words == counts(texts[0])[4]
