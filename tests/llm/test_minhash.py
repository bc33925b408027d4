import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubjay.llm import components, minhash, queries

SETTINGS = minhash.Settings(shingle=4)


def sets_of(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def by_hand(rows, size, percent=80):
    """doc_id -> (size of its set, smallest id of its class), by comparing all pairs."""
    sets = {i: sets_of(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, count, words, groups):
    out = []
    for _ in range(groups):
        base = ["".join(rng.choice(list("abcdefgh"), size=5)) for _ in range(words)]
        for _ in range(count):
            text = list(base)
            for k in rng.integers(0, words, size=rng.integers(0, 1 + words // 25)):
                text[k] = "".join(rng.choice(list("abcdefgh"), size=6))
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(6)
    texts = near_copies(rng, 25, 90, 4) + ["", None, "a b", "A B", "a b c", " \n", "x y z w", "x  y\nz w", "É y z w", "é y z w"]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(spark, df, SETTINGS._replace(block=block)).collect()}
    assert got == by_hand(rows, 4)


@pytest.mark.parametrize("anchors", [1, 4])
def test_hot_group_beside_all_pairs(spark, anchors):
    """One group far larger than a block, of two families that anchors of one do not join, and members that only others reach."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=5))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(400):
        text = list(base)
        start = 0 if i < 250 else 10  # the second family differs from the first in ten words
        for k in range(start):
            text[k * 2] = f"second{k}"
        for k in rng.integers(0, 100, size=rng.integers(0, 5)):
            text[k] = word()
        rows.append((i, " ".join(text)))
    settings = SETTINGS._replace(block=16, anchors=anchors, unit=64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    want = by_hand(rows, 4)
    assert got == want and 1 < len({c for _, c in want.values()}) < 200


def test_hot_bucket_of_many_texts(spark):
    """50,000 different texts in one bucket, two words apart at most, are one class."""
    base = "one common text of a good many words that very many documents share but for a number at its end and perhaps some more".split() * 4
    base = [f"{w}{k}" for k, w in enumerate(base)]
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(base)), F.concat(F.lit("no"), F.col("id"))).alias("text"))
    got = minhash.classes(spark, rows).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("firsts")).collect()
    assert [(r.component_id, r.n, r.firsts) for r in got] == [(0, 50_000, 1)]


def test_rows_are_told_apart_by_more_than_ids(spark):
    """Repeated ids of different texts, ids that are null, and columns with clashing names: no text is lost, no copy stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(7, a, 1), (None, a, 2), (None, None, 3), (5, b, 4), (5, c, 5), (5, c, 6), (None, b + " end", 7), (None, "only here", 8), (None, "Only here", 9), (None, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long").withColumns({n: F.lit(1) for n in ("row", "number", "digest", "first", "name", "of", "node", "component_id")})
    kept = minhash.unique(spark, docs)
    assert kept.columns == docs.columns
    found = sorted((r.text or "", r.kept_id) for r in kept.collect())
    assert [t for t, _ in found] == sorted(["", "", a, b, c, found[[t.lower() for t, _ in found].index("only here")][0]])
    ids = {r.kept_id: r.doc_id for r in kept.collect()}
    assert {1, 3, 4, 10} <= ids.keys() and len(ids.keys() & {5, 6}) == 1 and len(ids.keys() & {8, 9}) == 1 and len(ids) == 6
    found = minhash.classes(spark, docs)
    assert found.where("first").count() == 6 and sorted(r.component_id or 0 for r in found.collect()) == [0, 0, 0, 0, 5, 5, 5, 5, 7, 7]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.classes(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count() and minhash.classes(spark, no_docs).count() == 0
    named = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert named[100].component_id == named[10].component_id == 10 and named[0].component_id == 0 and named[0].n_shingles == 0
    assert sorted((r.component_id is None, r.component_id or 0) for r in rows if r.doc_id is None) == [(False, 10), (True, 0)]


def test_estimates_are_near_the_truth():
    rng, settings = np.random.default_rng(9), minhash.Settings(rows=16, bands=32)
    factors = minhash.multipliers(settings)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:both], pool[2000 : 2000 + n - both]])
        sa, sb = (minhash.packed(minhash.minima(minhash.mixed(x), factors), settings.bits) for x in (a, b))
        assert minhash.similarity(sa, sb, settings) == pytest.approx(share, abs=0.08)


def test_components(spark, scratch_dir):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(200, 400)] + [(500, int(k)) for k in range(501, 560)] + [tuple(map(int, rng.integers(600, 900, 2))) for _ in range(150)] + [(7, 7)]
    forest = components.Forest()
    for a, b in pairs:
        forest.link(a, b)
    want = {m: r for m, r in zip(*forest.edges()) if m != r}
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = components.components(df, f"{scratch_dir}/cc").collect()
    assert {r.a: r.b for r in got} == want and len(got) == len(want)


def tasks_of(spark, run):
    """(result, number of tasks) of what run starts."""
    group = f"tasks-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))


def graph_and_classes():
    """Paths, hubs from above and below and a random graph; its nodes but the roots, with their roots."""
    rng = np.random.default_rng(8)
    pairs = [(i, i + 1) for i in range(150)] + [(200, k) for k in range(201, 260)] + [(400, k) for k in range(300, 360)] + [tuple(map(int, rng.integers(600, 900, 2))) for _ in range(200)]
    forest = components.Forest()
    for a, b in pairs:
        forest.link(a, b)
    return pairs, {m: r for m, r in zip(*forest.edges()) if m != r}


def test_few_edges_cost_few_tasks(spark, scratch_dir):
    """With many partitions, the rounds would deal a small graph out to thousands of tasks."""
    pairs, want = graph_and_classes()
    names = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in names}
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got, tasks = tasks_of(spark, lambda: components.components(df, f"{scratch_dir}/few").collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.a: r.b for r in got} == want and len(got) == len(want)
    assert 0 < tasks < 97


@pytest.mark.parametrize("few", [0, 250])
def test_components_in_rounds(spark, scratch_dir, few):
    """Rounds to the end, and rounds as long as there are more edges than are left to one task."""
    pairs, want = graph_and_classes()
    got = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(40), f"{scratch_dir}/rounds-{few}", few=few).collect()
    assert {r.a: r.b for r in got} == want and len(got) == len(want)


def test_hot_group_of_one_component_reads_texts_once(spark, monkeypatch):
    """Where the anchors join all of a group, no second pass over it follows; where they don't, it does."""
    base = [f"w{k}" for k in range(100)]
    passes = []
    sets = minhash.shingle_sets
    monkeypatch.setattr(minhash, "shingle_sets", lambda settings: passes.append(1) or sets(settings))
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    settings = SETTINGS._replace(block=16)
    got = minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_hand(rows, 4) and len(passes) == 1


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op9_bbit_minhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_hand(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_has_the_columns_of_its_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(queries.OP9_SQL)
    names = [d[0] for d in want.description]
    got = queries.op9_bbit_minhash(spark, sf_dir)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
