"""Stream forms against their batch forms, over files that arrive one by one."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelens.operators import logs as G
from pagelens.operators.fold import ordered_fold
from pagelens.streaming import logs as SL

T0 = datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, make, mode="append"):
    """All that a stream gives for rows that come in three files."""
    for k in range(3):
        spark.createDataFrame(rows[k::3] if mode == "complete" else rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    name = f"t{abs(hash(str(tmp_path)))}"
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_console_counts(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=10 * i), "error", f"failed to load item {i % 4}") for i in range(90)]
    got = streamed(spark, tmp_path, rows, "ts timestamp, level string, text string", SL.console_shape_counts, "complete")
    batch = SL.console_shape_counts(spark.createDataFrame(rows, "ts timestamp, level string, text string"))
    assert sorted(got.collect()) == sorted(batch.collect())
    assert got.agg(F.sum("n")).first()[0] == 90


def test_budget_stream(spark, tmp_path):
    limits = {"action": 8, "navigation": 3, "download": 2, "new_origin": 99}
    rows = [(i % 2, i, ("navigation", "download", "other")[i % 3]) for i in range(40)]
    schema = "session long, seq long, kind string"
    got = streamed(spark, tmp_path, rows, schema, lambda s: SL.charge_budget_stream(s, limits))
    batch = G.charge_budget(spark.createDataFrame(rows, schema).withColumns({"ts": F.lit(0.0), "origin": F.lit(None).cast("string")}), limits)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)


def test_repeats_in_a_stream(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=i), i % 5) for i in range(30)]
    got = streamed(spark, tmp_path, rows, "ts timestamp, k long", lambda s: SL.without_repeats(s, ["k"]))
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3, 4]


def test_fold_of_null_and_hot_keys(spark):
    rows = [(None if i % 4 == 0 else 7, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, i long")
    counted = lambda state, row: (row[0], row[1], state.append(1) or len(state))
    got = ordered_fold(df, "k", ["i"], list, counted, "k long, i long, n long")
    assert {(r.k, r.m) for r in got.groupBy("k").agg(F.max("n").alias("m")).collect()} == {(None, 1250), (7, 3750)}
    assert ordered_fold(df.where("i < 0"), "k", ["i"], list, counted, "k long, i long, n long").count() == 0
