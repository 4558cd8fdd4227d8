"""A stream of files gives the steps of the batch operator."""

import datetime as dt

from flowloom.streaming.live import live_counts, live_steps

AT = dt.datetime(2026, 1, 1)
SCHEMA = "case_id string, activity string, ts timestamp"


def stream(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame([(c, a, AT + dt.timedelta(hours=h)) for c, a, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_steps_over_batches(spark, tmp_path):
    got = run(live_steps(stream(spark, tmp_path, [[("A", "x", 0), ("B", "x", 1)], [("A", "y", 12), ("B", "z", 2), ("", "q", 3)], [("A", "z", 11.5)]]), "20 hours"), tmp_path, "steps")
    told = sorted((r["case_id"], r["from_activity"], r["to_activity"], r["wait_days"], r["out_of_order"]) for r in got)
    assert told == [("A", "x", "y", 0.5, False), ("A", "y", "z", None, True), ("B", "x", "z", 1 / 24, False)]


def test_counts_come_after_the_watermark(spark, tmp_path):
    got = run(live_counts(stream(spark, tmp_path, [[("A", "x", 0), ("B", "x", 1)], [("A", "y", 60)]])), tmp_path, "counts")
    assert [(r["activity"], r["n"]) for r in got] == [("x", 2)]
