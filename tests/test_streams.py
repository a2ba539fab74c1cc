"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from brindle.operators.logs import throttle
from brindle.streaming import jobs

SCHEMA = "key bigint, at double, id bigint"


def _log(spark, path):
    df = spark.range(60).select((F.col("id") % 4).alias("key"), (F.col("id") * 7.0).alias("at"), "id")
    for k in range(3):
        df.where(f"id div 20 = {k}").coalesce(1).write.mode("append").parquet(path)
    return df


def test_throttle(spark, tmp_path):
    df = _log(spark, f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = jobs.throttled(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 2, 100.0)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: r.accepted for r in throttle(df, 2, 100.0).collect()}


def test_retention_and_ingest(spark, tmp_path):
    _log(spark, f"{tmp_path}/in")
    jobs.retained(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/log", f"{tmp_path}/c1", 10, ["at", "id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/log/0").collect()) == list(range(50, 60))
    for c in ("c2", "c3"):  # the second run sees all files again
        jobs.incremental(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/target", f"{tmp_path}/{c}", lambda b: b, "id").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/target").count() == 60


def test_throttle_with_watermark(spark, tmp_path):
    """Keys whose attempts no longer count are forgotten; an attempt behind the watermark is left out."""
    rows = [[(1, 0.0, 0), (1, 10.0, 1), (1, 20.0, 2), (2, 20.0, 3)], [(3, 500.0, 4)], [(3, 505.0, 5), (1, 30.0, 6), (1, 506.0, 7)], [(3, 510.0, 8)]]
    for part in rows:
        spark.createDataFrame([(key, 1000 + at, i) for key, at, i in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = jobs.throttled(stream, 2, 100.0, "50 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: got[k] for k in (0, 1, 2, 3, 4, 5, 7, 8)} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 7: True, 8: False}
    assert 6 not in got
    # held and its timer of keys 1 and 3; key 2 is forgotten
    assert state <= 6, q.lastProgress["stateOperators"]
