"""Event logs made of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.schema import NO_RESOURCE

SESSION_GAP_HOURS = 12
STAGES = ["signup", "view", "click", "purchase", "error"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int") % 7
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(
        "event_id", "user_id", micros.alias("us"), F.col("event_type").alias("activity"),
        F.when(k == 0, NO_RESOURCE).otherwise(F.concat(F.lit("R"), k.cast("string"))).alias("resource"),
    )


def _log(df: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("map<string,string>")
    return df.select("seq", "case_id", "activity", "ts_ms", "resource", F.lit("unknown").alias("lifecycle"), nothing.alias("attributes"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each session of a user: a gap of more than twelve hours begins a new one."""
    by_user = Window.partitionBy("user_id").orderBy("us", "event_id")
    before = F.lag("us").over(by_user)
    new = before.isNull() | (F.col("us") - before > SESSION_GAP_HOURS * 3_600_000_000)
    number = F.sum(F.col("new").cast("int")).over(by_user)
    cases = _events(spark, sf_dir).withColumn("new", new).withColumn("case_id", F.concat_ws("-", "user_id", number))
    return _log(cases.select(F.col("event_id").alias("seq"), "case_id", "activity", F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), "resource"))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each user."""
    e = _events(spark, sf_dir)
    return _log(e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), "activity", F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), "resource"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each conversation, a minute for each turn."""
    c = _table(spark, sf_dir, "conversations")
    return _log(c.select(F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"), (F.col("turn") * 60_000).alias("ts_ms"), F.lit(NO_RESOURCE).alias("resource")))


def order_line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order, an event for each line."""
    lines = _table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _log(lines.select(
        F.row_number().over(order).cast("long").alias("seq"), F.col("l_orderkey").cast("string").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"), F.col("l_suppkey").cast("string").alias("resource"),
    ))


def order_work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order: it is received, worked on in one of several ways, and closed, an hour for each step.

    Of four orders, one has two steps in one order or the other, two have one step up to three times, and one has three steps
    that begin anywhere in their ring.
    """
    o, ring = F.col("o_orderkey"), F.array(*map(F.lit, ["blend", "cut", "dry"]))
    both = F.array(F.lit("assess"), F.lit("audit"))
    turn = F.floor(o / 4)
    turned = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(ring, ((turn + i) % 3).cast("int")))
    packs = F.array_repeat(F.lit("pack"), (turn % 3 + 1).cast("int"))
    way = F.when(o % 4 == 1, F.when(turn % 2 == 0, both).otherwise(F.reverse(both))).when(o % 4 == 2, turned).otherwise(packs)
    cases = _table(spark, sf_dir, "orders").select(F.lpad(o.cast("string"), 12, "0").alias("case_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start"), F.concat(F.array(F.lit("received")), way, F.array(F.lit("closed"))).alias("path"))
    steps = cases.select("case_id", "start", F.posexplode("path").alias("at", "activity"))
    return _log(steps.select(F.col("at").cast("long").alias("seq"), "case_id", "activity", (F.col("start") + F.col("at") * 3_600_000).alias("ts_ms"), F.lit(NO_RESOURCE).alias("resource")))


def funnel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the session log, the events whose stage exceeds all stages before."""
    log = session_log(spark, sf_dir)
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("activity"))
    before = Window.partitionBy("case_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumn("stage", stage).withColumn("most", F.max("stage").over(before))
    return seen.where("most is null or stage > most").drop("stage", "most")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session log as text rows with faults: blank activities, exact copies, bad times, changed order."""
    log, e = session_log(spark, sf_dir), F.col("seq")
    iso = F.concat(F.date_format(F.timestamp_millis(F.col("ts_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    faulty = log.select(
        # a changed place: three rows earlier
        (F.when(e % 79 == 0, e * 2 - 7).otherwise(e * 2)).alias("seq"), "case_id", F.when(e % 97 == 0, " ").otherwise(F.col("activity")).alias("activity"),
        F.when(e % 83 == 0, "sem data").otherwise(iso).alias("timestamp"), F.when(F.col("resource") == NO_RESOURCE, "").otherwise(F.col("resource")).alias("resource"),
        F.when(e % 2 == 0, "COMPLETE").otherwise("other").alias("lifecycle"), e.alias("event_id"),
    )
    copies = faulty.where("event_id % 89 = 0").withColumn("seq", F.col("seq") + 1)
    return faulty.unionByName(copies)
