from pyspark.sql import functions as F

from scrubjay.streaming import text_stream


def test_cleans_what_arrives(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", "a\u200bb"), (2, "2024-01-01 00:07:00", "plain")], "id long, at string, text string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    text_stream.run_available(text_stream.cleaned(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: (r.clean, r.changed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("ab", True), 2: ("plain", False)}
    query = text_stream.counts(stream, "at").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.texts, r.changed, r.removed) for r in spark.table("counts").collect()) == [(1, 0, 0), (1, 1, 1)]
