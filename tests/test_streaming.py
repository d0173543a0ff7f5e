"""Streaming forms give what the batch forms give."""

import numpy as np
from pyspark.sql import functions as F

from anamnesis.operators import graph
from anamnesis.streaming import twins


def test_edges_equal_the_batch_fold(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(a), int(b), float(s), float(t)) for a, b, s, t in zip(r.integers(0, 4, 40), r.integers(4, 8, 40), r.random(40), np.sort(r.random(40)) * 1e5, strict=True)]
    schema = "src long, dst long, strength double, ts double"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = twins.edges(stream).writeStream.outputMode("update").format("memory").queryName("edges_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {(x.src, x.dst): (x.activation_count, x.last_activated, x.weight) for x in graph.fold(spark.createDataFrame(rows, schema), F.lit(1e5)).collect()}
    got = {(x.src, x.dst): x for x in spark.table("edges_out").collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        n, last, weight = want[k]
        assert (x.activation_count, x.last_activated) == (n, last)
        assert abs(x.weight * 0.5 ** ((1e5 - last) / 604_800) - weight) < 1e-9


def test_ingestion_stores_each_row_once(spark, tmp_path):
    spark.createDataFrame([(1, "I prefer tea", "cli"), (2, "mail me@x.org", "cli")], "id long, content string, source string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, content string, source string").parquet(f"{tmp_path}/in")
    append = lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    for _ in range(2):
        twins.ingest(stream, append, f"{tmp_path}/c").awaitTermination(120)
    got = {r.id: (r.category, r.masked_content) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("Preference", None), 2: ("Conversation", "mail [MASKED:email]")}


def test_breaker_states(spark):
    rows = spark.createDataFrame([(0, 0.0, 9.0), (5, 0.0, 10.0), (5, 0.0, 60.0)], "failed int, last double, now double")
    got = [r.s for r in rows.select(twins.breaker_state(F.col("failed"), F.col("last"), F.col("now")).alias("s")).collect()]
    assert got == ["closed", "open", "half-open"]


def test_requests_beyond_the_rate_are_refused(spark, tmp_path):
    rows = [("a", 1.1), ("a", 1.2), ("a", 1.9), ("a", 2.0), ("b", 1.5), ("a", 7.0)]
    spark.createDataFrame(rows, "client string, ts double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client string, ts double").parquet(f"{tmp_path}/in")
    twins.decided(stream, 2).writeStream.format("memory").queryName("decided_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.client, r.ts, r.allowed) for r in spark.table("decided_out").collect()) == [("a", 1.1, True), ("a", 1.2, True), ("a", 1.9, False), ("a", 2.0, True), ("a", 7.0, True), ("b", 1.5, True)]
