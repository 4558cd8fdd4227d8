"""The stored rollup: refreshes, versions and readers of old ones."""

import os

import pytest
from pyspark.sql import functions as F

from flowloom.operators import rollup, traces

FIELDS = ["case_id", "seq", "from_activity", "to_activity", "event_ms", "next_event_ms"]


def rows(df):
    return sorted(map(tuple, df.select(*FIELDS).collect()), key=repr)


def test_a_refresh_makes_only_changed_buckets_anew(spark, make_log, tmp_path):
    path = str(tmp_path / "r")
    log = make_log([(f"c{i}", ["a", "b", "c"], []) for i in range(200)]).withColumn("seq", F.col("seq") * 2)
    assert rollup.build(log, path, buckets=32) == 1
    assert rows(rollup.read(spark, path)) == rows(traces.edge_rollup(log))
    before = rollup.read(spark, path)
    old = rollup.view(spark, path, "steps_so_far")
    new = make_log([("c3", ["late"], []), ("c7", ["late", "x"], []), ("new", ["a"], [])]).withColumn("seq", F.col("seq") * 2 + 5001)
    version, made = rollup.refresh(new, path)
    touched = new.select(F.pmod(F.xxhash64("case_id"), F.lit(32)).alias("b")).distinct().count()
    assert (version, made) == (2, touched) and touched <= 3
    whole = rows(traces.edge_rollup(log.unionByName(new)))
    assert rows(rollup.read(spark, path)) == whole
    assert len(os.listdir(f"{path}/data/version=2")) - 1 - sum(x.startswith(".") for x in os.listdir(f"{path}/data/version=2")) == touched
    # readers of the version before see what they saw
    assert rows(before) == rows(old) == rows(rollup.read(spark, path, 1)) == rows(traces.edge_rollup(log))
    assert rows(rollup.view(spark, path, "steps_so_far")) == whole


def test_events_that_come_again_replace_themselves(spark, make_log, tmp_path):
    path = str(tmp_path / "r")
    log = make_log([("a", ["x", "y", "z"], []), ("b", ["x"], [])])
    rollup.build(log, path, buckets=4)
    again = log.where("seq = 1").withColumn("activity", F.lit("new"))
    assert rollup.refresh(again, path)[1] == 1
    assert rows(rollup.read(spark, path)) == rows(traces.edge_rollup(log.where("seq <> 1").unionByName(again)))
    assert rollup.refresh(log.limit(0), path) == (2, 0)
    assert rollup.vacuum(spark, path) == 1 and rollup.read(spark, path).count() == 4


def test_a_failed_refresh_changes_nothing(spark, make_log, tmp_path):
    path = str(tmp_path / "r")
    log = make_log([("a", ["x", "y"], [])])
    rollup.build(log, path)
    bad = log.withColumn("activity", F.when(F.col("seq") == 0, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        rollup.refresh(bad, path)
    assert rollup.latest(spark, path) == 1 and rows(rollup.read(spark, path)) == rows(traces.edge_rollup(log))
    assert rollup.refresh(log.withColumn("case_id", F.lit("z")), path)[0] == 2
    assert rollup.read(spark, path).count() == 4


def test_an_empty_log(spark, make_log, tmp_path):
    path = str(tmp_path / "r")
    log = make_log([("a", ["x", "y"], [])])
    rollup.build(log.limit(0), path)
    assert rows(rollup.read(spark, path)) == []
    rollup.refresh(log, path)
    assert rows(rollup.read(spark, path)) == rows(traces.edge_rollup(log))
