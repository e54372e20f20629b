"""The streaming counterparts give what the batch versions give."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidegate.streaming.windows import once, sessions, tumbling


def run(spark, tmp_path, build, mode="append"):
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path)))}"
    build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def events(spark, tmp_path):
    df = spark.read.parquet(str(DATA / "events.parquet")).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def test_tumbling_and_sessions(spark, tmp_path):
    df = events(spark, tmp_path)
    n = [F.count(F.lit(1)).alias("n")]
    for build in (lambda d, w: tumbling(d, "ts", "6 hours", ["event_type"], n, watermark=w), lambda d, w: sessions(d, "ts", "30 minutes", ["user_id"], n, watermark=w)):
        got = run(spark, tmp_path, lambda s, b=build: b(s, "2 days"))
        want = sorted(map(tuple, build(df, None).collect()), key=str)
        assert set(got) <= set(want)  # what the watermark has not passed stays open
    whole = run(spark, tmp_path, lambda s: tumbling(s, "ts", "6 hours", ["event_type"], n), mode="complete")
    assert whole == sorted(map(tuple, tumbling(df, "ts", "6 hours", ["event_type"], n).collect()), key=str)


def test_once(spark, tmp_path):
    df = events(spark, tmp_path)
    df.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path, lambda s: once(s, ["event_id"], "ts", "60 days").select("event_id"))
    assert len(got) == len(set(got)) == df.select("event_id").distinct().count()
