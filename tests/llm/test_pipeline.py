import re

import corpus_pipeline
from pyspark.sql import functions as F

from scrubjay.llm import queries


def test_stages_one_after_the_other(spark, sf_dir):
    """Each stage beside a plain reading of what it should keep of its own input."""
    from tests.llm.test_minhash import by_hand

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "near_duplicates", "packing"]
    spoken = stages["language"](spark, docs, sf_dir).cache()
    assert spoken.columns == docs.columns and spoken.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    good = stages["quality"](spark, spoken, sf_dir).cache()
    ids = {r.doc_id for r in good.collect()}
    lost = [r.doc_id for r in spoken.collect() if r.doc_id not in ids and labels.get(r.doc_id) == 1 and len(r.text.split()) >= 50]
    assert good.columns == docs.columns and len(lost) <= 1
    unique = stages["near_duplicates"](spark, good, sf_dir).cache()
    want = {i for i, (_, c) in by_hand([(r.doc_id, r.text) for r in good.collect()], 5).items() if i == c}
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(want)
    pieces = stages["packing"](spark, unique, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == want


def test_repeated_rows_leave_one(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect() if r.doc_id is not None]
    assert len(kept) == len(set(kept)) and 10 in kept and 100 not in kept
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_every_operator_has_its_query():
    numbers = sorted(int(m[1]) for m in map(re.compile(r"op(\d+)_").match, queries.queries()) if m)
    assert numbers == list(range(1, 11))


def test_unknown_languages_go_and_mixed_texts_stay(spark, sf_dir):
    """What is in none of the learned languages goes, whatever its labels' shares; a clean text in two of them stays."""
    import random

    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    long = {r.lang: r.text.split() for r in docs.orderBy("doc_id").collect() if len(r.text.split()) > 300}
    en, fr = long["en"][:300], long["fr"][:300]
    garbled = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(200))
    russian = "Все люди рождаются свободными и равными в своём достоинстве и правах. " * 9
    gone = {-1: russian, -2: "我们今天去北京大学学习中文，非常高兴。" * 9, -3: garbled, -4: "The of " + russian + " and the", -5: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."}
    stay = {-11: " ".join(en + fr), -12: " ".join(fr[:2] + en + fr[-2:]), -13: " ".join(en) + " " + russian, -14: "the", -15: " ".join(en).upper()}
    extra = spark.createDataFrame([(i, t, None, "s") for i, t in {**gone, **stay}.items()], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf_dir).collect()}
    assert not kept & gone.keys() and stay.keys() <= kept and len(kept) == docs.where(F.col("text").rlike(r"\p{L}")).count() + len(stay)


def test_python_workers_get_small_batches(spark, sf_dir):
    """Texts of 16 MB in one task: no batch of a stage's session has more than 1 MiB and a row, unless a limit was set before."""
    import pyarrow as pa

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own in (None, str(4 << 20)):
        for stage in ("language", "near_duplicates", "packing"):
            fresh = spark.newSession()
            if own:
                fresh.conf.set(name, own)
            docs = fresh.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 400).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
            dict(corpus_pipeline.STAGES)[stage](fresh, docs.limit(0), sf_dir)
            most = max(r.n for r in docs.mapInArrow(bytes_of, "n long").collect())
            assert most <= (int(own) if own else 1 << 20) + (64 << 10) and (own is None or most > 1 << 21), stage
