from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewave.operators import clean
from tidewave.streaming import packets

START = datetime(2024, 1, 1)


def feed(spark, tmp_path, rows):
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(k, START + timedelta(seconds=t), x) for k, t, x in part], "k string, ts timestamp, x long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema("k string, ts timestamp, x long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


ROWS = [[("a", 0.0, 1), ("a", 2.0, 3), ("a", 1.0, 2)], [("a", 2.5, 4), ("b", 3.0, 9), ("a", 4.0, 5)], [("z", 1000.0, 0)], [("z", 2000.0, 1)]]


def test_merge_equals_the_batch_operator(spark, tmp_path):
    out = drained(packets.merged_packets(feed(spark, tmp_path, ROWS), "k", "ts", "x", 2.0, "5 seconds"), tmp_path, "merged")
    base = spark.createDataFrame([r for part in ROWS for r in part], "k string, t double, x long")
    want = clean.anchored_groups(base, ["k"], "t", F.col("x"), 2.0).where("k <> 'z'")
    got = {(r.k, r.group_start - START.timestamp(), tuple(r["items"])) for r in out.where("k <> 'z'").collect()}
    assert got == {(r.k, r.group_start, tuple(r["items"])) for r in want.collect()}


def test_late_packets_are_dropped_from_windows(spark, tmp_path):
    rows = [*ROWS[:3], [("z", 1001.0, 0)], [("a", 0.5, 100)], ROWS[3]]  # the bound for late rows is one batch old
    out = drained(packets.window_statistics(feed(spark, tmp_path, rows), ["k"], "ts", "x", "10 seconds", "10 seconds", "5 seconds"), tmp_path, "stats")
    r = out.where("k = 'a'").collect()
    assert [(x.n, x["mean"]) for x in r] == [(5, 3.0)]
