"""The edge rollup as a stored table that is refreshed by what has changed.

Cases are dealt to buckets by the hash of their ids. A refresh makes anew only the buckets that have new events, under a new
version, and then commits the version: a small table that tells, for every bucket, which version of it holds. Readers of
an earlier version go on reading its files, which nothing removes but `vacuum`. A refresh that fails before its commit
leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.traces import edge_rollup

BUCKETS = 64
EVENTS = ["case_id", "seq", "activity", "ts_ms"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, made int, buckets int, version int").parquet(f"{path}/versions")


def latest(spark: SparkSession, path: str) -> int:
    return _commits(spark, path).agg(F.max("version")).first()[0]


def _places(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """bucket -> the version that made it; a row for each bucket that has rows."""
    return {r["bucket"]: r["made"] for r in _commits(spark, path).where((F.col("version") == version) & F.col("bucket").isNotNull()).collect()}


def _store(events: DataFrame, path: str, version: int, buckets: int) -> set[int]:
    """Write the rollup of whole cases, a folder for each bucket; the buckets that were written."""
    spark = events.sparkSession
    target = f"{path}/data/version={version}"
    edge_rollup(events).withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    return {r["bucket"] for r in spark.read.schema("case_id string, bucket int").parquet(target).select("bucket").distinct().collect()}


def _commit(spark: SparkSession, path: str, version: int, buckets: int, places: dict[int, int]) -> None:
    # a row without a bucket keeps the number of buckets where no bucket has rows
    rows = [(b, made, buckets) for b, made in sorted(places.items())] + [(None, None, buckets)]
    spark.createDataFrame(rows, "bucket int, made int, buckets int").coalesce(1).write.parquet(f"{path}/versions/version={version}")


def build(log: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """The rollup of a whole log as version 1 of a new table."""
    made = _store(log, path, 1, buckets)
    _commit(log.sparkSession, path, 1, buckets, dict.fromkeys(made, 1))
    return 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the rollup, the latest one if none is named."""
    version = latest(spark, path) if version is None else version
    places = _places(spark, path, version)
    schema = "case_id string, seq long, from_activity string, to_activity string, event_ms long, next_event_ms long"
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/version={made}/bucket={b}" for b, made in sorted(places.items())))


def refresh(new: DataFrame, path: str) -> tuple[int, int]:
    """(version, buckets made anew) after adding the events of `new`; an event of a case and seq that is there already replaces it.

    Without new events no version is made.
    """
    spark = new.sparkSession
    version = latest(spark, path)
    buckets = _commits(spark, path).where(F.col("version") == version).agg(F.max("buckets")).first()[0]
    events = new.select(*EVENTS)
    touched = {r["bucket"] for r in events.select(_bucket(buckets).alias("bucket")).distinct().collect()}  # BUCKETS rows at most
    if not touched:
        return version, 0
    places = _places(spark, path, version)
    old = [f"{path}/data/version={places[b]}/bucket={b}" for b in sorted(touched) if b in places]
    if old:
        there = spark.read.schema(read(spark, path, version).schema).parquet(*old).select("case_id", "seq", F.col("from_activity").alias("activity"), F.col("event_ms").alias("ts_ms"))
        events = there.join(events.select("case_id", "seq"), ["case_id", "seq"], "left_anti").unionByName(events)
    made = _store(events, path, version + 1, buckets)
    _commit(spark, path, version + 1, buckets, places | dict.fromkeys(made, version + 1))
    return version + 1, len(made)


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The latest version as a view; making it again after a refresh shows that one, and frames made from the view before keep theirs."""
    read(spark, path).createOrReplaceTempView(name)
    return spark.table(name)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the folders that the latest version does not need; how many. Only when nobody reads earlier versions."""
    needed = _places(spark, path, latest(spark, path))
    jvm, conf, removed = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = data.getFileSystem(conf)
    for version in fs.listStatus(data):
        number = int(version.getPath().getName().split("=")[1])
        for folder in fs.listStatus(version.getPath()):
            name = folder.getPath().getName()
            if name.startswith("bucket=") and needed.get(int(name.split("=")[1])) != number:
                removed += bool(fs.delete(folder.getPath(), True))
    return removed
