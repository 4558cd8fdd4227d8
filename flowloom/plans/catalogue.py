"""All queries of the process-mining operators by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import text as text_functions
from flowloom.functions.hashing import stable_hash, text_id
from flowloom.operators import analysis, conformance, evidence, model, profile, quality, ranking, responses, rollup, waits
from flowloom.operators import traces as base
from flowloom.sources import adapters, files
from flowloom.sources.scratch import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, whole numbers as BIGINT."""
    how = {"double": six, "int": lambda c: c.cast("long")}
    return df.select(*(how[t](F.col(n)).alias(n) if t in how else F.col(n) for n, t in df.dtypes))


def six(c: Column) -> Column:
    """A double at six decimals as SQL's round tells it: the product with a million decides a half, and not the digits that show the double."""
    return F.round(c * 1e6) / 1e6


def shown(path: str = "path"):
    return F.array_join(path, " > ").alias("path")


# ---- the same log in SQL

HASH = """list_reduce(list_prepend({seed}::HUGEINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::HUGEINT)), lambda a, b: (xor(a, b) * {factor}) % 4294967296)"""


def half_sql(text: str, which: int) -> str:
    seed, factor = ((2166136261, 16777619), (2654435769, 2246822507))[which]
    return HASH.format(seed=seed, factor=factor, text=text)


def hash_sql(text: str) -> str:
    return " || ".join(f"lpad(lower(to_hex(({half_sql(text, i)})::BIGINT)), 8, '0')" for i in (0, 1))


SESSION = """
WITH ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS activity, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS k FROM events
), flagged AS (
  SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
), log AS (
  SELECT event_id AS seq, user_id || '-' || (sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id))::BIGINT AS case_id, activity, us // 1000 AS ts_ms,
    CASE WHEN k = 0 THEN 'Não informado' ELSE 'R' || k END AS resource FROM flagged
)"""

STEPS = SESSION + """, steps AS (
  SELECT case_id, seq, activity, resource, ts_ms, lead(activity) OVER w AS next_activity, lead(ts_ms) OVER w AS next_ts_ms,
    greatest(0.0, (lead(ts_ms) OVER w - ts_ms) / 86400000.0) AS wait FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts_ms, seq)
), st AS (SELECT * EXCLUDE (wait), CASE WHEN next_activity IS NOT NULL THEN wait END AS wait_days, CASE WHEN next_activity IS NOT NULL THEN greatest(0, next_ts_ms - ts_ms) END AS wait_ms FROM steps)"""

TRACES = SESSION + """, traces AS (
  SELECT case_id, list(activity ORDER BY ts_ms, seq) AS path, string_agg(activity, chr(31) ORDER BY ts_ms, seq) AS path_key, count(*) AS n_events,
    min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, greatest(0.0, (max(ts_ms) - min(ts_ms)) / 86400000.0) AS lead_days, max(ts_ms) - min(ts_ms) AS lead_ms FROM log GROUP BY case_id
)"""

SPLIT = TRACES + f", sides AS (SELECT *, {half_sql('case_id', 0)} % 5 = 0 AS is_validation FROM traces)"
PAIRS = """, p AS (
  SELECT is_validation, unnest(path[:len(path) - 1]) AS from_activity, unnest(path[2:]) AS to_activity FROM {sides} WHERE len(path) > 1
)"""


def summary_sql(ms: str, prefix: str = "") -> str:
    """In days, of a column of milliseconds: whole numbers are averaged and parted, and divided last."""
    days = lambda x: f"coalesce({x}, 0) / 86400000"
    cut = lambda p: days(f"quantile_cont({ms}, {p})")
    told = {
        "n": f"count({ms})", "mean": days(f"avg({ms})"), "sd": days(f"stddev_samp({ms})"), "min": days(f"min({ms})"), "p25": cut(0.25), "median": cut(0.5),
        "p75": cut(0.75), "p90": cut(0.9), "p95": cut(0.95), "max": days(f"max({ms})"), "iqr": f"{cut(0.75)} - {cut(0.25)}",
    }
    return ", ".join(f"{v} AS {prefix}{k}" if k == "n" else f"round({v}, 6) AS {prefix}{k}" for k, v in told.items())


EDGES = STEPS + f""", edges AS (
  SELECT activity AS from_activity, next_activity AS to_activity, count(DISTINCT case_id) AS case_count, {summary_sql('wait_ms')}
  FROM st WHERE next_activity IS NOT NULL GROUP BY ALL
), named AS (SELECT *, 'edge:' || {hash_sql("from_activity || chr(31) || to_activity")} AS edge_id FROM edges)"""
ACTIVITIES = STEPS + f""", acts AS (
  SELECT activity, count(*) AS events, count(DISTINCT case_id) AS case_count,
    coalesce(list_sort(list(DISTINCT resource) FILTER (WHERE resource <> 'Não informado')), []) AS resources, {summary_sql('wait_ms', 'wait_')} FROM st GROUP BY activity
)"""
VARIANTS = TRACES + f""", overall AS (SELECT quantile_cont(lead_ms, 0.5) / 86400000 AS m, count(*) AS total FROM traces), vars AS (
  SELECT path_key, any_value(path) AS path, {summary_sql('lead_ms', 'lead_')}, round(count(*) / any_value(total), 6) AS share,
    round(quantile_cont(lead_ms, 0.5) / 86400000 - any_value(m), 6) AS impact FROM traces, overall GROUP BY path_key
), vnamed AS (SELECT *, 'variant:' || {hash_sql('path_key')} AS variant_id FROM vars)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.session_log(spark, sf_dir)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.steps(_log(spark, sf_dir))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.traces(_log(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.edge_stats(_steps(spark, sf_dir))


def _activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.activity_stats(_steps(spark, sf_dir))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.variant_stats(_traces(spark, sf_dir))


def _named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("edge_id", text_id("edge", F.col("from_activity"), F.col("to_activity")))


def _sides(log: DataFrame) -> DataFrame:
    return base.split(base.traces(log))


# ---- traces and steps


@query(STEPS + " SELECT case_id, seq, activity, next_activity, round(wait_days, 6) AS wait_days FROM st")
def steps(spark, sf_dir):
    return _steps(spark, sf_dir).select("case_id", "seq", "activity", "next_activity", "wait_days")


@query(SESSION + " SELECT case_id, seq, activity AS from_activity, lead(activity) OVER w AS to_activity, ts_ms AS event_ms, lead(ts_ms) OVER w AS next_event_ms FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq)")
def edge_rollup(spark, sf_dir):
    return base.edge_rollup(_log(spark, sf_dir))


@query(SESSION + " SELECT activity AS from_activity, lead(activity) OVER w AS to_activity, seq FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq)")
def edge_rollup_view(spark, sf_dir):
    """The rollup as a stored table behind a view, asked by SQL."""
    path = scratch_path(spark, "rollup")
    rollup.build(_log(spark, sf_dir), path)
    rollup.view(spark, path, "process_edge_rollup")
    return spark.sql("SELECT from_activity, to_activity, seq FROM process_edge_rollup")


@query(SESSION + " SELECT case_id, seq, activity AS from_activity, lead(activity) OVER w AS to_activity, ts_ms AS event_ms, lead(ts_ms) OVER w AS next_event_ms FROM log WINDOW w AS (PARTITION BY case_id ORDER BY seq)")
def edge_rollup_refresh(spark, sf_dir):
    """A rollup of nine tenths of the events, refreshed with the rest: what a rollup of all would be."""
    log, path = written(_log(spark, sf_dir), "log"), scratch_path(spark, "rollup")
    rollup.build(log.where("seq % 10 <> 0"), path)
    rollup.refresh(log.where("seq % 10 = 0"), path)
    return rollup.read(spark, path)


@query(TRACES + " SELECT case_id, array_to_string(path, ' > ') AS path, n_events, round(lead_days, 6) AS lead_days FROM traces")
def traces(spark, sf_dir):
    return _traces(spark, sf_dir).select("case_id", shown(), "n_events", "lead_days")


@query("""
WITH log AS (SELECT l_orderkey, l_returnflag || l_linestatus AS activity, epoch_us(l_shipdate) // 1000 AS ts_ms, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT l_orderkey::VARCHAR AS case_id, string_agg(activity, ' > ' ORDER BY ts_ms, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS path, count(*) AS n_events,
  round(greatest(0.0, (max(ts_ms) - min(ts_ms)) / 86400000.0), 6) AS lead_days FROM log GROUP BY l_orderkey""")
def order_traces(spark, sf_dir):
    return base.traces(adapters.order_line_log(spark, sf_dir)).select("case_id", shown(), "n_events", "lead_days")


@query("""
WITH log AS (SELECT event_id AS seq, user_id::VARCHAR AS case_id, event_type AS activity, epoch_us(ts) // 1000 AS ts_ms FROM events)
SELECT case_id, string_agg(activity, ' > ' ORDER BY ts_ms, seq) AS path, count(*) AS n_events, round(greatest(0.0, (max(ts_ms) - min(ts_ms)) / 86400000.0), 6) AS lead_days FROM log GROUP BY case_id""")
def user_traces(spark, sf_dir):
    return base.traces(adapters.user_log(spark, sf_dir)).select("case_id", shown(), "n_events", "lead_days")


@query(TRACES + f" SELECT case_id, {hash_sql('case_id')} AS hash16 FROM traces")
def hash_ids(spark, sf_dir):
    return _traces(spark, sf_dir).select("case_id", stable_hash(F.col("case_id")).alias("hash16"))


@query(SPLIT + " SELECT case_id, is_validation FROM sides")
def holdout_split(spark, sf_dir):
    return _sides(_log(spark, sf_dir)).select("case_id", "is_validation")


# ---- statistics


@query(EDGES + ", t AS (SELECT sum(n) AS total FROM edges) SELECT e.*, round(e.n / total, 6) AS frequency FROM edges e, t")
def edge_stats(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(ACTIVITIES + " SELECT * REPLACE (array_to_string(resources, ',') AS resources) FROM acts")
def activity_stats(spark, sf_dir):
    return _activities(spark, sf_dir).withColumn("resources", F.array_join("resources", ","))


@query(VARIANTS + " SELECT variant_id, array_to_string(path, ' > ') AS path, lead_n AS n, share, lead_mean, lead_median, lead_p90, lead_sd, impact FROM vnamed")
def variant_stats(spark, sf_dir):
    return _variants(spark, sf_dir).select(text_id("variant", F.col("path_key")).alias("variant_id"), shown(), "n", "share", "lead_mean", "lead_median", "lead_p90", "lead_sd", "impact")


@query(TRACES + " SELECT strftime(make_timestamp(end_ms * 1000), '%Y-%m') AS month, count(*) AS cases, round(quantile_cont(lead_ms, 0.5) / 86400000, 6) AS median_lead_days FROM traces GROUP BY 1")
def trend(spark, sf_dir):
    return profile.trend(_traces(spark, sf_dir))


@query("""
WITH c AS (SELECT l_orderkey, max(epoch_us(l_shipdate) // 1000) AS end_ms, greatest(0.0, (max(epoch_us(l_shipdate) // 1000) - min(epoch_us(l_shipdate) // 1000)) / 86400000.0) AS lead_days, max(epoch_us(l_shipdate) // 1000) - min(epoch_us(l_shipdate) // 1000) AS lead_ms FROM lineitem GROUP BY 1)
SELECT strftime(make_timestamp(end_ms * 1000), '%Y-%m') AS month, count(*) AS cases, round(quantile_cont(lead_ms, 0.5) / 86400000, 6) AS median_lead_days FROM c GROUP BY 1""")
def order_trend(spark, sf_dir):
    return profile.trend(base.traces(adapters.order_line_log(spark, sf_dir)))


@query(TRACES + """ SELECT count(*) AS case_count, round(avg(lead_ms) / 86400000, 6) AS avg_lead_days, round(quantile_cont(lead_ms, 0.5) / 86400000, 6) AS median_lead_days, round(quantile_cont(lead_ms, 0.9) / 86400000, 6) AS p90_lead_days,
  round(avg(CASE WHEN len(list_distinct(path)) = len(path) THEN 1.0 ELSE 0.0 END), 6) AS first_pass_rate, sum(n_events - 1)::BIGINT AS transition_count, (SELECT count(*) FROM log) AS event_count FROM traces""")
def metrics(spark, sf_dir):
    return profile.metrics(_log(spark, sf_dir), _traces(spark, sf_dir))


@query(TRACES + f" SELECT 'all' AS what, {summary_sql('lead_ms')} FROM traces")
def distribution_summary(spark, sf_dir):
    from flowloom.functions.stats import summarise

    return summarise(_traces(spark, sf_dir).withColumn("what", F.lit("all")), "lead_ms", "what")


@query(EDGES + " SELECT edge_id, from_activity, to_activity, n, median, p90 FROM named ORDER BY median DESC, n DESC, edge_id LIMIT 1")
def bottleneck(spark, sf_dir):
    return profile.bottlenecks(_edges(spark, sf_dir), 1).select("edge_id", "from_activity", "to_activity", "n", "median", "p90")


@query(EDGES + " SELECT edge_id, from_activity, to_activity, n, median, p90 FROM named ORDER BY median DESC, n DESC, edge_id LIMIT 4")
def ui_bottlenecks(spark, sf_dir):
    return profile.bottlenecks(_edges(spark, sf_dir), 4).select("edge_id", "from_activity", "to_activity", "n", "median", "p90")


@query(EDGES + ", b AS (SELECT list_sort(list(median)) AS m FROM edges) SELECT from_activity, to_activity, n, median, median >= m[least(len(m), floor(len(m) * 0.7)::BIGINT + 1)] AS is_hot FROM edges, b")
def edge_hot(spark, sf_dir):
    return profile.edge_heat(_edges(spark, sf_dir)).select("from_activity", "to_activity", "n", "median", "is_hot")


@query(SPLIT + " SELECT DISTINCT 'start' AS kind, path[1] AS activity FROM sides WHERE NOT is_validation UNION SELECT DISTINCT 'end', path[-1] FROM sides WHERE NOT is_validation")
def start_end(spark, sf_dir):
    return profile.start_end(_sides(_log(spark, sf_dir)).where("not is_validation"))


@query(SPLIT + PAIRS.format(sides="sides") + ", b AS (SELECT greatest(1, ceil(count(*) * 0.01)) AS bound FROM sides WHERE NOT is_validation) SELECT from_activity, to_activity, count(*) AS n, count(*) >= any_value(bound) AS retained FROM p, b WHERE NOT is_validation GROUP BY 1, 2")
def retained_edges(spark, sf_dir):
    return profile.retained_edges(_sides(_log(spark, sf_dir)).where("not is_validation"))


@query(TRACES + ", d AS (SELECT unnest(path[:len(path) - 1]) AS from_activity, unnest(path[2:]) AS to_activity FROM traces WHERE len(path) > 1) SELECT from_activity, to_activity, count(*) AS n FROM d GROUP BY 1, 2")
def dfg(spark, sf_dir):
    return profile.follows(_traces(spark, sf_dir))


@query(EDGES + " SELECT from_activity, to_activity, n FROM named WHERE from_activity = 'click' OR to_activity = 'click' ORDER BY n DESC, edge_id LIMIT 3")
def activity_edges(spark, sf_dir):
    return profile.edges_of(_edges(spark, sf_dir), "click").select("from_activity", "to_activity", "n")


@query(EDGES + """, tr AS (SELECT case_id, list(activity ORDER BY ts_ms, seq) AS path, string_agg(activity, chr(31) ORDER BY ts_ms, seq) AS path_key, greatest(0.0, (max(ts_ms) - min(ts_ms)) / 86400000.0) AS lead_days, max(ts_ms) - min(ts_ms) AS lead_ms FROM log GROUP BY case_id),
tv AS (SELECT path_key, any_value(path) AS path, count(*) AS n, quantile_cont(lead_ms, 0.5) / 86400000 AS m FROM tr GROUP BY path_key),
best AS (SELECT path FROM tv ORDER BY n DESC, m DESC, path_key LIMIT 1),
shown AS (SELECT from_activity, to_activity, n, edge_id, path FROM named, best WHERE list_contains(path, from_activity) AND list_contains(path, to_activity))
SELECT from_activity, to_activity, n, list_position(list_distinct_ordered, from_activity)::BIGINT AS from_stage, list_position(list_distinct_ordered, to_activity)::BIGINT AS to_stage
FROM (SELECT *, list_filter(path, lambda x, i: list_position(path, x) = i) AS list_distinct_ordered FROM shown) ORDER BY n DESC, edge_id LIMIT 26""")
def dfg_map(spark, sf_dir):
    return profile.flow_map(_edges(spark, sf_dir), _variants(spark, sf_dir))


@query(SESSION + ", e AS (SELECT max(ts_ms) AS m FROM log) SELECT seq, case_id, activity, ts_ms, resource FROM log WHERE case_id IN (SELECT case_id FROM log, e WHERE resource = 'R3' AND ts_ms >= m - 5 * 86400000)")
def case_filter(spark, sf_dir):
    return profile.filter_cases(_log(spark, sf_dir), "R3", 5).select("seq", "case_id", "activity", "ts_ms", "resource")


@query(SESSION + " SELECT seq, case_id, activity, ts_ms, resource FROM log")
def case_filter_guard(spark, sf_dir):
    """A filter that leaves less than two events leaves all."""
    return profile.filter_cases(_log(spark, sf_dir), "R99", 5).select("seq", "case_id", "activity", "ts_ms", "resource")


@query(VARIANTS + " SELECT variant_id, array_to_string(path, ' > ') AS path, lead_n AS n FROM vnamed WHERE contains(lower(array_to_string(path, ' ') || ' ' || variant_id), 'click view')")
def variant_search(spark, sf_dir):
    found = profile.search_variants(_variants(spark, sf_dir), "Click View")
    return found.select(text_id("variant", F.col("path_key")).alias("variant_id"), shown(), "n")


@query(SESSION + " SELECT DISTINCT resource FROM log WHERE resource <> ''")
def resources(spark, sf_dir):
    return profile.resources(_log(spark, sf_dir))


@query(SESSION + " SELECT count(DISTINCT case_id) AS cases FROM log")
def case_count(spark, sf_dir):
    return profile.case_count(_log(spark, sf_dir))


@query(VARIANTS + " SELECT variant_id, lead_n AS n, share, row_number() OVER (ORDER BY lead_n DESC, impact DESC, variant_id) AS rank FROM vnamed")
def variant_rank(spark, sf_dir):
    cdf = profile.variant_cdf(_variants(spark, sf_dir).withColumn("impact", six(F.col("impact"))))
    return cdf.select("variant_id", "n", "share", "rank")


@query(TRACES + " SELECT count(DISTINCT path_key) AS variants, count(*) AS cases FROM traces")
def variant_diversity(spark, sf_dir):
    return profile.variant_diversity(_traces(spark, sf_dir))


@query("""
WITH log AS (SELECT conv_id, turn, role FROM conversations), t AS (SELECT string_agg(role, ' > ' ORDER BY turn) AS path FROM log GROUP BY conv_id),
v AS (SELECT path, count(*) AS n FROM t GROUP BY path)
SELECT path, n, round(sum(n) OVER (ORDER BY n DESC, path ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS upto FROM v""")
def variant_cdf(spark, sf_dir):
    """Over conversations, in the order of count and path."""
    v = base.traces(adapters.conversation_log(spark, sf_dir)).groupBy(shown()).agg(F.count("*").alias("n"))
    out = ranking.ranked(v, F.struct((-F.col("n")).alias("n"), "path"), "n")
    return out.select("path", "n", (F.col("upto") / F.col("of")).alias("upto"))


# ---- cleaning

DIRTY = SESSION + """, faulty AS (
  SELECT CASE WHEN seq % 79 = 0 THEN seq * 2 - 7 ELSE seq * 2 END AS seq, case_id, CASE WHEN seq % 97 = 0 THEN '' ELSE activity END AS activity,
    CASE WHEN seq % 83 = 0 THEN NULL ELSE ts_ms END AS ts_ms, resource, seq AS event_id FROM log
), raw AS (SELECT * FROM faulty UNION ALL SELECT seq + 1, case_id, activity, ts_ms, resource, event_id FROM faulty WHERE event_id % 89 = 0),
tagged AS (SELECT *, CASE WHEN activity = '' THEN 'missing_required_value' WHEN ts_ms IS NULL THEN 'invalid_timestamp' END AS reject_reason FROM raw),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id, activity, ts_ms, resource ORDER BY seq) AS nth FROM tagged WHERE reject_reason IS NULL),
clean AS (SELECT * FROM numbered WHERE nth = 1),
late AS (SELECT * FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY case_id ORDER BY seq) AS previous_ms FROM clean) WHERE ts_ms < previous_ms)"""
FINDINGS = DIRTY + """, found AS (
  SELECT reject_reason AS code, case_id, 0 AS t, '' AS c, seq FROM tagged WHERE reject_reason IS NOT NULL
  UNION ALL SELECT 'duplicate_event', case_id, 0, '', seq FROM numbered WHERE nth > 1
  UNION ALL SELECT 'out_of_order_event', case_id, 0, '', seq FROM late
  UNION ALL SELECT 'single_event_case', case_id, min(ts_ms), case_id, min(seq) FROM clean GROUP BY case_id HAVING count(*) = 1
  UNION ALL SELECT 'missing_resource', case_id, ts_ms, case_id, seq FROM clean WHERE resource = 'Não informado'
), firsts AS (SELECT code, case_id, count(*) AS n, min((t, c, seq)) AS met FROM found GROUP BY 1, 2)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.raw_rows(spark, sf_dir)


@query(DIRTY + " SELECT reject_reason, count(*) AS n FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 1")
def dq_rejects(spark, sf_dir):
    return quality.tagged(_raw(spark, sf_dir)).where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000 // 1000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 86400000000 * 86400000 WHEN 3 THEN epoch_us(ts) // 1000 // 1000 * 1000 END AS ts_ms FROM events""")
def dq_timestamps(spark, sf_dir):
    """Times as epoch seconds, epoch milliseconds, dates, ISO texts, and a text that is no time."""
    ts, e = F.col("ts").cast("timestamp"), F.col("event_id")
    raw = F.when(e % 5 == 0, F.unix_seconds(ts).cast("string")).when(e % 5 == 1, F.unix_millis(ts).cast("string")).when(e % 5 == 2, F.date_format(ts, "yyyy-MM-dd"))
    raw = raw.when(e % 5 == 3, F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "))).otherwise("ontem")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text_functions.timestamp_ms(raw).alias("ts_ms"))


@query(DIRTY + " SELECT seq, case_id, activity, ts_ms, resource FROM clean")
def dedup(spark, sf_dir):
    return quality.clean(_raw(spark, sf_dir)).select("seq", "case_id", "activity", "ts_ms", "resource")


@query(DIRTY + " SELECT seq, case_id, row_number() OVER (ORDER BY ts_ms, case_id, seq) AS place FROM clean")
def log_order(spark, sf_dir):
    """The clean log's order: time, collated case, input."""
    order = F.struct("ts_ms", F.collate("case_id", "UNICODE").alias("c"), "seq")
    return ranking.ranked(quality.clean(_raw(spark, sf_dir)).select("seq", "case_id", "ts_ms"), order, "seq").select("seq", "case_id", F.col("rank").alias("place"))


@query(DIRTY + " SELECT seq, case_id, ts_ms, previous_ms FROM late")
def out_of_order(spark, sf_dir):
    return quality.out_of_order(quality.clean(_raw(spark, sf_dir))).select("seq", "case_id", "ts_ms", "previous_ms")


@query(FINDINGS + """ SELECT code, CASE WHEN code IN ('missing_required_value', 'invalid_timestamp') THEN 'error' ELSE 'warning' END AS severity, sum(n)::BIGINT AS n,
  array_to_string((list(case_id ORDER BY met))[:5], ',') AS sample_case_ids FROM firsts GROUP BY code""")
def quality_issues(spark, sf_dir):
    return quality.issues(_raw(spark, sf_dir)).select("code", "severity", "n", F.array_join("sample_case_ids", ",").alias("sample_case_ids"))


@query(DIRTY + """ SELECT count(*) AS input_rows, (SELECT count(*) FROM clean) AS accepted_events, count(reject_reason) AS rejected_rows, (SELECT count(DISTINCT case_id) FROM clean) AS case_count,
  round((count(*) * 3 - count(reject_reason) * 3) / (count(*) * 3), 6) AS completeness, true AS is_usable FROM tagged""")
def quality_report(spark, sf_dir):
    return quality.report(_raw(spark, sf_dir))


_ATTRIBUTE = ["", "TRUE", "false", "12", "-3,5", "1200,50", "1.200,5", "abc", " 7.25 ", "x1"]


@query("""WITH a AS (SELECT event_id, (['', 'TRUE', 'false', '12', '-3,5', '1200,50', '1.200,5', 'abc', ' 7.25 ', 'x1'])[(event_id % 10 + 1)::INTEGER] AS raw FROM events)
SELECT event_id, raw, CASE WHEN trim(raw) = '' THEN 'null' WHEN lower(raw) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(trim(raw), '-?[0-9]+([.,][0-9]+)?') THEN 'number' ELSE 'string' END AS kind,
  CASE WHEN regexp_full_match(trim(raw), '-?[0-9]+([.,][0-9]+)?') THEN round(replace(trim(raw), ',', '.')::DOUBLE, 6) END AS value FROM a""")
def attr_infer(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, _ATTRIBUTE)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", text_functions.attribute_kind(F.col("raw")).alias("kind"), text_functions.attribute_number(F.col("raw")).alias("value"))


@query("""SELECT event_id, day(ts) || ' de ' || (['jan.', 'fev.', 'mar.', 'abr.', 'mai.', 'jun.', 'jul.', 'ago.', 'set.', 'out.', 'nov.', 'dez.'])[month(ts)] || ' de ' || strftime(ts, '%Y, %H:%M') AS label FROM events""")
def timestamp_labels(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text_functions.timestamp_label(ms).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'complete' ELSE 'start' END AS lifecycle FROM events")
def lifecycle_norm(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("COMPLETE"), F.lit(" Start"), F.lit("resume")), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text_functions.lifecycle_name(raw).alias("lifecycle"))


# ---- model and conformance

FUNNEL = SESSION + """, staged AS (SELECT *, list_position(['signup', 'view', 'click', 'purchase', 'error'], activity) AS stage FROM log),
seen AS (SELECT *, max(stage) OVER (PARTITION BY case_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM staged),
funnel AS (SELECT case_id, list(activity ORDER BY ts_ms, seq) AS path FROM seen WHERE most IS NULL OR stage > most GROUP BY case_id),
fsides AS (SELECT *, """ + half_sql("case_id", 0) + " % 5 = 0 AS is_validation FROM funnel)"


@query(FUNNEL + PAIRS.format(sides="fsides") + """, tr AS (SELECT DISTINCT from_activity, to_activity FROM p WHERE NOT is_validation), va AS (SELECT DISTINCT from_activity, to_activity FROM p WHERE is_validation),
n AS (SELECT (SELECT count(*) FROM tr) AS t, (SELECT count(*) FROM va) AS h, (SELECT count(*) FROM tr SEMI JOIN va USING (from_activity, to_activity)) AS b)
SELECT round(CASE WHEN t > 0 THEN b / t ELSE 1 END, 6) AS precision, round(CASE WHEN h > 0 THEN b / h ELSE 1 END, 6) AS generalization FROM n""")
def precision_generalization(spark, sf_dir):
    return conformance.coverage(_sides(adapters.funnel_log(spark, sf_dir)))


ALIGNED = SPLIT.replace("WITH ev", "WITH RECURSIVE ev", 1) + f""", held AS (SELECT path_key, any_value(path) AS a FROM sides WHERE is_validation GROUP BY path_key),
known AS (SELECT path_key, any_value(path) AS b FROM sides WHERE NOT is_validation GROUP BY path_key),
lcs AS (
  SELECT held.path_key AS hk, known.path_key AS tk, a, b, 0 AS i, list_transform(b, lambda x: 0) AS len FROM held, known
  UNION ALL
  SELECT hk, tk, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN coalesce(len[k - 1], 0) + 1 ELSE len[k] END))) FROM lcs WHERE i < len(a)
), costs AS (SELECT hk, tk, len(a) AS m, len(b) AS n, len(a) + len(b) - 2 * len[len(b)] AS cost FROM lcs WHERE i = len(a)),
best AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY hk ORDER BY cost, replace(tk, chr(31), '')) = 1),
aligned AS (
  SELECT case_id, 'variant:' || {hash_sql('hk')} AS variant_id, 'variant:' || {hash_sql('tk')} AS reference_variant_id, cost, greatest(0.0, 1 - cost / greatest(1, m + n)) AS fitness, cost > 0 AS is_deviation
  FROM sides JOIN best ON path_key = hk WHERE is_validation
)"""


@query(ALIGNED + " SELECT * REPLACE (round(fitness, 6) AS fitness) FROM aligned")
def alignments(spark, sf_dir):
    return conformance.alignments(base.stored(_log(spark, sf_dir)), moves=False)


#: Rows of the table of common lengths, for the winning pairs, and the way back through them.
@query(ALIGNED + """, won AS (SELECT l.hk, l.a, l.b, l.i, l.len FROM lcs l JOIN best USING (hk, tk)),
back AS (
  SELECT hk, a, b, len(a) AS i, len(b) AS j, '' AS told FROM won WHERE i = 0
  UNION ALL
  SELECT hk, a, b, i - (kind <> 'model')::INT, j - (kind <> 'log')::INT,
    '{"kind":"' || kind || '"' || CASE WHEN kind <> 'model' THEN ',"log_activity":"' || a[i] || '"' ELSE '' END || CASE WHEN kind <> 'log' THEN ',"model_activity":"' || b[j] || '"' ELSE '' END
      || ',"cost":' || (kind <> 'sync')::INT || '}' || CASE WHEN told = '' THEN '' ELSE ',' || told END
  FROM (
    SELECT back.*, CASE WHEN back.i > 0 AND back.j > 0 AND back.a[back.i] = back.b[back.j] THEN 'sync'
      WHEN back.i > 0 AND (back.j = 0 OR up.len[back.j] >= coalesce(here.len[back.j - 1], 0)) THEN 'log' ELSE 'model' END AS kind
    FROM back LEFT JOIN won up ON up.hk = back.hk AND up.i = back.i - 1 LEFT JOIN won here ON here.hk = back.hk AND here.i = back.i
    WHERE back.i > 0 OR back.j > 0
  )
)
SELECT case_id, '[' || told || ']' AS moves FROM back JOIN sides ON path_key = hk WHERE is_validation AND i = 0 AND j = 0""")
def alignment_moves(spark, sf_dir):
    """The moves of each alignment as JSON."""
    return conformance.alignments(base.stored(_log(spark, sf_dir))).select("case_id", F.to_json("moves").alias("moves"))


CONFORMED = ALIGNED + PAIRS.format(sides="sides") + """, tp AS (SELECT DISTINCT from_activity, to_activity FROM p WHERE NOT is_validation), vp AS (SELECT DISTINCT from_activity, to_activity FROM p WHERE is_validation),
pn AS (SELECT (SELECT count(*) FROM tp) AS t, (SELECT count(*) FROM vp) AS h, (SELECT count(*) FROM tp SEMI JOIN vp USING (from_activity, to_activity)) AS b),
conf AS (
  SELECT count(*) AS aligned_cases, count(*) FILTER (WHERE is_deviation) AS deviating_cases, avg(is_deviation::INTEGER) AS deviation_rate, avg(cost) AS mean_cost, quantile_cont(cost, 0.5) AS median_cost, avg(fitness) AS fitness,
    any_value(CASE WHEN t > 0 THEN b / t ELSE 1 END) AS precision, any_value(CASE WHEN h > 0 THEN b / h ELSE 1 END) AS generalization,
    (SELECT count(*) FROM sides WHERE NOT is_validation) AS train_cases, (SELECT count(*) FROM sides WHERE is_validation) AS validation_cases FROM aligned, pn
)"""
_ROUNDED = "SELECT * REPLACE (round(deviation_rate, 6) AS deviation_rate, round(mean_cost, 6) AS mean_cost, round(median_cost, 6) AS median_cost, round(fitness, 6) AS fitness, round(precision, 6) AS precision, round(generalization, 6) AS generalization) FROM conf"


@query(CONFORMED + _ROUNDED)
def conformance_summary(spark, sf_dir):
    return conformance.summary(base.stored(_log(spark, sf_dir)))


#: The funnel's stages come in one order only, so its tree is their sequence.
@query(FUNNEL + """, seen_activities AS (SELECT DISTINCT unnest(path) AS activity FROM fsides WHERE NOT is_validation),
staged_activities AS (SELECT activity, row_number() OVER (ORDER BY list_position(['signup', 'view', 'click', 'purchase', 'error'], activity)) AS i FROM seen_activities)
SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 0::BIGINT AS ord, 'sequence' AS operator, NULL AS activity, 0::BIGINT AS depth
UNION ALL SELECT i, 0, i - 1, 'activity', activity, 1 FROM staged_activities""")
def process_tree(spark, sf_dir):
    return model.tree_table(spark, _sides(adapters.funnel_log(spark, sf_dir)).where("not is_validation"))


#: By its making, the log's tree has one of each cut: a sequence around a choice of two activities in any order, of three that follow
#: each other in a ring (no cut: its paths, the first case's first) and of one that repeats.
@query("""
WITH c AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS case_id, o_orderkey // 4 % 3 AS way FROM orders WHERE o_orderkey % 4 = 2), ring AS (SELECT way, row_number() OVER (ORDER BY min(case_id)) - 1 AS ord FROM c GROUP BY way),
fixed AS (
  SELECT * FROM (VALUES (0, NULL, 0, 'sequence', NULL, 0), (1, 0, 0, 'activity', 'received', 1), (2, 0, 1, 'xor', NULL, 1), (3, 2, 0, 'parallel', NULL, 2), (4, 3, 0, 'activity', 'assess', 3), (5, 3, 1, 'activity', 'audit', 3),
    (6, 2, 1, 'xor', NULL, 2), (19, 2, 2, 'loop', NULL, 2), (20, 19, 0, 'activity', 'pack', 3), (21, 19, 1, 'tau', NULL, 3), (22, 0, 2, 'activity', 'closed', 1)) AS t(node_id, parent_id, ord, operator, activity, depth)
)
SELECT node_id::BIGINT AS node_id, parent_id::BIGINT AS parent_id, ord::BIGINT AS ord, operator, activity, depth::BIGINT AS depth FROM fixed
UNION ALL SELECT 7 + 4 * ord, 6, ord, 'sequence', NULL, 3 FROM ring
UNION ALL SELECT 8 + 4 * ord + i, 7 + 4 * ord, i, 'activity', (['blend', 'cut', 'dry'])[(way + i) % 3 + 1], 4 FROM ring, (SELECT unnest(range(3)) AS i)""")
def process_tree_cuts(spark, sf_dir):
    return model.tree_table(spark, base.traces(adapters.order_work_log(spark, sf_dir)))


@query(FUNNEL + PAIRS.format(sides="fsides") + f""", tr AS (SELECT * FROM fsides WHERE NOT is_validation), bound AS (SELECT greatest(1, ceil(count(*) * 0.01))::BIGINT AS least FROM tr),
counted AS (SELECT from_activity, to_activity, count(*) AS n FROM p WHERE NOT is_validation GROUP BY 1, 2),
kept AS (SELECT list_sort(list('edge:' || {hash_sql("from_activity || chr(31) || to_activity")})) AS ids FROM counted, bound WHERE n >= least),
acts AS (SELECT DISTINCT unnest(path) AS activity FROM tr)
SELECT 'inductive-dfg' AS algorithm, '2.0.0' AS algorithm_version, least AS min_edge_frequency, (SELECT array_to_string(list_sort(list(DISTINCT path[1])), ',') FROM tr) AS start_activities,
  (SELECT array_to_string(list_sort(list(DISTINCT path[-1])), ',') FROM tr) AS end_activities, array_to_string(ids, ',') AS retained_edge_ids, len(ids) AS retained_edges, (SELECT count(*) FROM counted) AS total_edges,
  '{{"operator": "sequence", "children": [' || (SELECT string_agg('{{"operator": "activity", "activity": "' || activity || '"}}', ', ' ORDER BY list_position(['signup', 'view', 'click', 'purchase', 'error'], activity)) FROM acts) || ']}}' AS process_tree,
  0::BIGINT AS fallback_count FROM bound, kept""")
def process_model(spark, sf_dir):
    out = model.model(spark, _sides(adapters.funnel_log(spark, sf_dir)).where("not is_validation"))
    return out.select(*(F.array_join(n, ",").alias(n) if t.startswith("array") else n for n, t in out.dtypes))


@query(SESSION.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, both_logs AS (SELECT case_id, ts_ms, seq, activity FROM log UNION ALL SELECT 'c' || conv_id, turn * 60000, turn, 'turn:' || role FROM conversations),
tr AS (SELECT list(activity ORDER BY ts_ms, seq) AS path FROM both_logs GROUP BY case_id), p AS (SELECT DISTINCT unnest(path[:len(path) - 1]) AS a, unnest(path[2:]) AS b FROM tr WHERE len(path) > 1),
ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT activity, activity FROM both_logs), reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS activity, min(b) AS first FROM reach GROUP BY a)
SELECT (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS component, activity FROM least""")
def components(spark, sf_dir):
    """The session log and the conversations, whose activities have another name: parts that no pair links."""
    talk = adapters.conversation_log(spark, sf_dir).withColumn("case_id", F.concat(F.lit("c"), "case_id")).withColumn("activity", F.concat(F.lit("turn:"), "activity"))
    return model.components_table(spark, base.traces(_log(spark, sf_dir).unionByName(talk)))


# ---- simulation

SAMPLES = STEPS + """, sm AS (
  SELECT activity || chr(31) || next_activity AS key, greatest(1 / 1440.0, (next_ts_ms - ts_ms) / 86400000.0) AS value FROM st WHERE next_activity IS NOT NULL
  UNION ALL SELECT activity || chr(31) || '*', greatest(1 / 1440.0, (next_ts_ms - ts_ms) / 86400000.0) FROM st WHERE next_activity IS NOT NULL
)"""
_CDF = """0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - (1 / (1 + 0.3275911 * abs(z) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(z) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(z) / sqrt(2))) * (1.421413741
  + (1 / (1 + 0.3275911 * abs(z) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(z) / sqrt(2))) * 1.061405429)))) * exp(-(abs(z) / sqrt(2)) * (abs(z) / sqrt(2)))))"""
FITS = SAMPLES + f""", facts AS (
  SELECT key, count(*) AS n, greatest(1e-9, avg(value)) AS mean, sum(ln(value)) AS sl, avg(ln(value)) AS mu, coalesce(stddev_samp(ln(value)), 0) AS sd, greatest(1e-6, coalesce(stddev_samp(ln(value)), 0)) AS sigma,
    min(round(value, 8)) AS lo, max(round(value, 8)) AS hi FROM sm GROUP BY key
), ranked AS (
  SELECT key, value, n, mean, row_number() OVER (PARTITION BY key ORDER BY value) AS i, (ln(value) - mu) / sigma AS z FROM sm JOIN facts USING (key)
), ks AS (
  SELECT key, max(greatest(abs(1 - exp(-value / mean) - (i - 1) / n), abs(i / n - 1 + exp(-value / mean)))) AS ks_e, max(greatest(abs({_CDF} - (i - 1) / n), abs(i / n - ({_CDF})))) AS ks_l FROM ranked GROUP BY key
), bics AS (
  SELECT *, ln(n) - 2 * (n * ln(1 / mean) - n) AS bic_e, 2 * ln(n) - 2 * (-sl - n * ln(sigma * sqrt(2 * pi())) - (n - 1) * sd * sd / (2 * sigma * sigma)) AS bic_l FROM facts JOIN ks USING (key)
), chosen AS (SELECT *, CASE WHEN n < 4 OR lo = hi THEN 'constant' WHEN bic_l <= bic_e THEN 'lognormal' ELSE 'exponential' END AS family FROM bics)"""


@query(SAMPLES + " SELECT replace(key, chr(31), ' > ') AS key, count(*) AS n, round(min(value), 6) AS lo, round(sum(value), 6) AS total FROM sm GROUP BY key")
def wait_samples(spark, sf_dir):
    by = waits.wait_samples(_steps(spark, sf_dir)).groupBy(F.replace("key", F.lit("\u001f"), F.lit(" > ")).alias("key"))
    return by.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.sum("value").alias("total"))


@query(FITS + " SELECT replace(key, chr(31), ' > ') AS key, round(ks_e, 6) AS ks_exponential, round(ks_l, 6) AS ks_lognormal FROM ks")
def ks_stat(spark, sf_dir):
    samples = waits.wait_samples(_steps(spark, sf_dir))
    facts = waits.sufficient(samples).withColumn("sigma", F.greatest(F.lit(1e-6), "sd_log"))
    return waits.ks_statistics(samples, facts).withColumn("key", F.replace("key", F.lit("\u001f"), F.lit(" > ")))


@query(FITS + """ SELECT replace(key, chr(31), ' > ') AS key, family, n AS sample_count, round(CASE family WHEN 'constant' THEN greatest(1 / 1440.0, mean) WHEN 'exponential' THEN mean ELSE mu END, 6) AS parameter_1,
  round(CASE family WHEN 'lognormal' THEN sigma END, 6) AS parameter_2, round(CASE family WHEN 'constant' THEN 0 WHEN 'exponential' THEN ks_e ELSE ks_l END, 6) AS ks, round(CASE family WHEN 'constant' THEN 0 WHEN 'exponential' THEN bic_e ELSE bic_l END, 3) AS bic FROM chosen""")
def fit_distributions(spark, sf_dir):
    fitted = waits.fits(waits.wait_samples(_steps(spark, sf_dir))).drop("warning")
    return fitted.withColumn("key", F.replace("key", F.lit("\u001f"), F.lit(" > "))).withColumn("bic", F.round("bic", 3))


_SUMMARIES = EDGES + ", acts AS " + ACTIVITIES.split(", acts AS ", 1)[1] + """, sm AS (
  SELECT from_activity || chr(31) || to_activity AS key, unnest(list_filter([p25, median, p75, p90], lambda x: x > 0)) AS value FROM edges
  UNION ALL SELECT activity || chr(31) || '*', CASE WHEN wait_median > 0 THEN wait_median ELSE 0.25 END FROM acts
)"""


@query(_SUMMARIES + FITS[len(SAMPLES):] + """ SELECT replace(key, chr(31), ' > ') AS key, family, n AS sample_count, round(CASE family WHEN 'constant' THEN greatest(1 / 1440.0, mean) WHEN 'exponential' THEN mean ELSE mu END, 6) AS parameter_1,
  round(CASE family WHEN 'lognormal' THEN sigma END, 6) AS parameter_2 FROM chosen""")
def summary_fits(spark, sf_dir):
    """Fits of summaries alone, as where raw events are missing."""
    edges, acts = rounded(_edges(spark, sf_dir)), rounded(_activities(spark, sf_dir))
    fitted = waits.fits(waits.summary_samples(edges, acts)).withColumn("key", F.replace("key", F.lit("\u001f"), F.lit(" > ")))
    return fitted.select("key", "family", "sample_count", "parameter_1", "parameter_2")


@query(ACTIVITIES + " SELECT activity, greatest(1, len(resources))::BIGINT AS capacity FROM acts")
def capacities(spark, sf_dir):
    return waits.capacities(_activities(spark, sf_dir))


@query(ACTIVITIES + ", s AS (SELECT activity AS slowest FROM acts ORDER BY wait_median DESC, events DESC, activity LIMIT 1) SELECT activity, (CASE WHEN activity = slowest THEN greatest(1, len(resources) - 1) ELSE greatest(1, len(resources)) END)::BIGINT AS capacity FROM acts, s")
def capacities_after_loss(spark, sf_dir):
    return waits.capacities(_activities(spark, sf_dir), True)


@query(TRACES + " SELECT count(*) AS cases, round(count(*) / greatest(1.0, (max(start_ms) - min(start_ms)) / 86400000.0), 6) AS arrival_rate FROM traces")
def arrival_rate(spark, sf_dir):
    return waits.arrival_rate(_traces(spark, sf_dir))


# ---- evidence


def _pt(x: str, decimals: int = 2) -> str:
    return f"translate(rtrim(rtrim(format('{{:,.{decimals}f}}', round({x}, {decimals})), '0'), '.'), ',.', '.,')"


WHOLE = CONFORMED + ", steps AS " + EDGES.split(", steps AS ", 1)[1] + ", acts AS " + ACTIVITIES.split(", acts AS ", 1)[1] + ", overall AS " + VARIANTS.split(", overall AS ", 1)[1]
_METRICS = """, mt AS (SELECT count(*) AS case_count, avg(lead_ms) / 86400000 AS avg_lead_days, quantile_cont(lead_ms, 0.5) / 86400000 AS median_lead_days, quantile_cont(lead_ms, 0.9) / 86400000 AS p90_lead_days,
  avg(CASE WHEN len(list_distinct(path)) = len(path) THEN 1.0 ELSE 0.0 END) AS first_pass_rate, sum(n_events - 1)::BIGINT AS transition_count, (SELECT count(*) FROM log) AS event_count FROM traces)"""


@query(CONFORMED + _METRICS + """ SELECT case_count, round(avg_lead_days, 6) AS avg_lead_days, round(median_lead_days, 6) AS median_lead_days, round(p90_lead_days, 6) AS p90_lead_days, round(first_pass_rate, 6) AS first_pass_rate,
  transition_count, event_count, round(deviation_rate, 6) AS deviation_rate, round(fitness, 6) AS fitness, round(precision, 6) AS precision FROM mt, conf""")
def analysis_metrics(spark, sf_dir):
    return analysis.analyse(spark, _log(spark, sf_dir)).metrics


_SOURCE = f"""lpad(lower(to_hex((sum({half_sql("line", 0)}) % 4294967296)::BIGINT)), 8, '0') || lpad(lower(to_hex((sum({half_sql("line", 1)}) % 4294967296)::BIGINT)), 8, '0')"""


@query(TRACES + f""", ls AS (SELECT row_number() OVER (ORDER BY seq) || '|' || case_id || '|' || activity || '|' || ts_ms || '|' || resource AS line, ts_ms FROM log), h AS (SELECT {_SOURCE} AS source_hash, max(ts_ms) AS last FROM ls),
hk AS (SELECT *, source_hash || '|2.0.0|' || (SELECT count(*) FROM traces) AS k FROM h)
SELECT '2.0' AS schema_version, 'analysis:' || {hash_sql('k')} AS analysis_id, source_hash, strftime(make_timestamp(last * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((last % 1000)::VARCHAR, 3, '0') || 'Z' AS generated_at FROM hk""")
def analysis_header(spark, sf_dir):
    return analysis.header(_log(spark, sf_dir))


@query(TRACES + " SELECT count(*) AS input_rows, count(*) AS accepted_events, 0::BIGINT AS rejected_rows, (SELECT count(*) FROM traces) AS case_count, 1.0::DOUBLE AS completeness, 0::BIGINT AS issue_types, count(*) >= 2 AS is_usable FROM log")
def default_quality(spark, sf_dir):
    return analysis.default_quality(_log(spark, sf_dir))


_COUNT = "translate(format('{{:,}}', {0}), ',', '.')".format
_DAYS = lambda x: f"{_pt(x)} || ' dias'"
_PERCENT = lambda x: f"{_pt(x + ' * 100', 1)} || '%'"


@query(WHOLE + _METRICS + f""", worst AS (SELECT * FROM named ORDER BY median DESC, n DESC, edge_id LIMIT 1), top AS (SELECT *, row_number() OVER (ORDER BY lead_n DESC, impact DESC, variant_id) AS i FROM vnamed QUALIFY i <= 3)
SELECT 'lead-time' AS id, 'distribution' AS kind, 'Lead time mediano' AS label, {_DAYS('median_lead_days')} AS value, 'P90 ' || {_DAYS('p90_lead_days')} || '; média ' || {_DAYS('avg_lead_days')} || '; ' || {_COUNT('case_count')} || ' casos.' AS detail, 'metrics.medianLeadDays' AS source_path FROM mt
UNION ALL SELECT 'volume', 'metric', 'Volume observado', {_COUNT('case_count')} || ' casos', {_COUNT('event_count')} || ' eventos e ' || (SELECT count(*) FROM acts) || ' atividades.', 'metrics.caseCount' FROM mt
UNION ALL SELECT 'conformance', 'conformance', 'Conformidade em holdout', {_PERCENT('fitness')} || ' fitness', 'Precisão ' || {_PERCENT('precision')} || '; generalização ' || {_PERCENT('generalization')} || '; ' || validation_cases || ' casos no holdout.', 'conformance' FROM conf
UNION ALL SELECT 'data-quality', 'quality', 'Completude de campos obrigatórios', '100%', '0 linhas rejeitadas; 0 tipos de alerta.', 'quality'
UNION ALL SELECT 'bottleneck', 'distribution', 'Maior espera mediana · ' || from_activity || ' → ' || to_activity, {_DAYS('median')}, 'P90 ' || {_DAYS('p90')} || '; IQR ' || {_DAYS('iqr')} || '; ' || {_COUNT('n')} || ' ocorrências.', 'edges.' || edge_id || '.waitDays' FROM worst
UNION ALL SELECT 'variant-' || i, 'variant', 'Variante ' || i, {_COUNT('lead_n')} || ' casos · ' || {_PERCENT('share')}, 'Lead mediano ' || {_DAYS('lead_median')} || '; impacto ' || {_DAYS('impact')} || '; ' || array_to_string(path, ' → ') || '.', 'variants.' || variant_id FROM top""")
def evidence_facts(spark, sf_dir):
    return analysis.analyse(spark, _log(spark, sf_dir)).evidence


@query(EDGES + " SELECT edge_id, from_activity, to_activity, n, mean, median, p90, p95, iqr FROM named ORDER BY n DESC, edge_id LIMIT 256")
def snapshot_edges(spark, sf_dir):
    return evidence.snapshot_edges(_edges(spark, sf_dir))


@query(VARIANTS + " SELECT variant_id, array_to_string(path, ' > ') AS path, lead_n AS n, share, lead_mean, lead_median, lead_p90, lead_p95, lead_iqr, impact FROM vnamed ORDER BY n DESC, impact DESC, variant_id LIMIT 32")
def snapshot_variants(spark, sf_dir):
    ranked = _variants(spark, sf_dir).withColumn("impact", six(F.col("impact")))
    return evidence.snapshot_variants(ranked).withColumn("path", F.array_join("path", " > "))


_EDGE_FACT = f""" SELECT 'tool-' || edge_id AS id, 'distribution' AS kind, from_activity || ' → ' || to_activity AS label, 'mediana ' || {_pt('median')} || ' dias' AS value,
  'P90 ' || {_pt('p90')} || ' dias; P95 ' || {_pt('p95')} || ' dias; IQR ' || {_pt('iqr')} || ' dias; ' || translate(format('{{:,}}', n), ',', '.') || ' ocorrências.' AS detail, 'edges.' || edge_id || '.waitDays' AS source_path FROM named"""


@query(EDGES + _EDGE_FACT + " WHERE from_activity = 'view' AND to_activity = 'click'")
def tool_inspect_transition(spark, sf_dir):
    edges = _named_edges(spark, sf_dir)
    wanted = spark.range(1).select(text_id("edge", F.lit("view"), F.lit("click")).alias("i")).first()["i"]
    return evidence.inspect_transition(rounded(edges), wanted)


@query(EDGES + _EDGE_FACT + " ORDER BY median DESC, n DESC, edge_id LIMIT 5")
def tool_rank_bottlenecks(spark, sf_dir):
    return evidence.rank_bottlenecks(rounded(_named_edges(spark, sf_dir)), 5)


@query(VARIANTS + f""", sided AS (SELECT *, CASE WHEN path_key = 'view' THEN 'left' ELSE 'right' END AS side FROM vnamed WHERE path_key IN ('view', 'click'))
SELECT left('tool-' || side || '-' || variant_id, 40) AS id, 'variant' AS kind, 'Variante ' || variant_id AS label, translate(format('{{:,}}', lead_n), ',', '.') || ' casos' AS value,
  'Participação ' || {_pt('share * 100', 1)} || '%; mediana ' || {_pt('lead_median')} || ' dias; P90 ' || {_pt('lead_p90')} || ' dias; impacto ' || {_pt('impact')} || ' dias.' AS detail, 'variants.' || variant_id AS source_path FROM sided""")
def tool_compare_variants(spark, sf_dir):
    named = rounded(_variants(spark, sf_dir)).withColumn("variant_id", text_id("variant", F.col("path_key")))
    ids = spark.range(1).select(text_id("variant", F.lit("view")).alias("a"), text_id("variant", F.lit("click")).alias("b")).first()
    return evidence.compare_variants(named, ids["a"], ids["b"])


_SNAPSHOT_FAULTS = """ SELECT 'variants: rows' AS fault, count(*) AS n FROM vnamed HAVING count(*) > 128"""


@query(VARIANTS + _SNAPSHOT_FAULTS)
def snapshot_faults(spark, sf_dir):
    """What a snapshot of all variants breaks."""
    edges, variants = _named_edges(spark, sf_dir), _variants(spark, sf_dir).withColumn("variant_id", text_id("variant", F.col("path_key")))
    return evidence.snapshot_faults(evidence.Snapshot("analysis:all", "0123456789abcdef", evidence.edge_facts(edges), edges, variants))


@query(EDGES + VARIANTS[len(SESSION):] + """, f AS (
  SELECT 'edges: rows' AS fault, CASE WHEN count(*) > 256 THEN count(*) END AS n FROM named UNION ALL SELECT 'edges: values', count(*) FILTER (WHERE from_activity = 'view' OR to_activity = 'click' AND n > 0) FROM named
  UNION ALL SELECT 'facts: rows', CASE WHEN count(*) NOT BETWEEN 1 AND 32 THEN count(*) END FROM named UNION ALL SELECT 'facts: values', count(*) FILTER (WHERE from_activity <> 'view') FROM named
  UNION ALL SELECT 'variants: rows', CASE WHEN count(*) > 128 THEN count(*) END FROM vnamed UNION ALL SELECT 'variants: values', count(*) FILTER (WHERE len(path) > 1 OR lead_n > 3) FROM vnamed UNION ALL SELECT 'ids', 1
) SELECT fault, n FROM f WHERE n > 0""")
def snapshot_faults_of_all_kinds(spark, sf_dir):
    """A snapshot that breaks its bounds in names, numbers, kinds, shares and ids."""
    edges, variants = _named_edges(spark, sf_dir), _variants(spark, sf_dir).withColumn("variant_id", text_id("variant", F.col("path_key")))
    facts = evidence.edge_facts(edges, "from_activity").withColumn("kind", F.when(F.col("from_activity") != "view", "guess").otherwise(F.col("kind")))
    edges = edges.withColumn("from_activity", F.when(F.col("from_activity") == "view", F.repeat("from_activity", 40)).otherwise(F.col("from_activity"))).withColumn("p90", F.when(F.col("to_activity") == "click", -1.0).otherwise(F.col("p90")))
    variants = variants.withColumn("share", F.when(F.col("n") > 3, 1.5).otherwise(F.col("share"))).withColumn("path", F.transform("path", lambda a: F.when(F.size("path") == 1, a).otherwise("")))
    return evidence.snapshot_faults(evidence.Snapshot("analysis:all", "short", facts, edges, variants))


@query(EDGES + """ SELECT left('tool-' || edge_id, 40) AS id, CASE WHEN from_activity = 'view' THEN 'metric' ELSE 'distribution' END AS kind, CASE WHEN to_activity = 'view' THEN 'legacy' ELSE 'edges.' || edge_id || '.waitDays' END AS source_path FROM named""")
def legacy_facts(spark, sf_dir):
    """Facts that lack a kind or a source, as a snapshot takes them."""
    facts = evidence.edge_facts(_named_edges(spark, sf_dir), "from_activity", "to_activity")
    old = facts.withColumn("kind", F.when(F.col("from_activity") != "view", F.col("kind"))).withColumn("source_path", F.when(F.col("to_activity") != "view", F.col("source_path")))
    return evidence.legacy_snapshot(old).facts.select("id", "kind", "source_path")


@query(EDGES + f""", old AS (SELECT 'tool-' || edge_id AS id, 'antes' AS value FROM named), new AS (SELECT * FROM ({_EDGE_FACT} ORDER BY median DESC, n DESC, edge_id LIMIT 5))
SELECT id, coalesce(new.value, old.value) AS value FROM old FULL JOIN new USING (id)""")
def merged_facts(spark, sf_dir):
    """Facts of all transitions with those of the slowest after them, which hold where both have an id."""
    edges = rounded(_named_edges(spark, sf_dir))
    return evidence.merged_facts([evidence.edge_facts(edges).withColumn("value", F.lit("antes")), evidence.rank_bottlenecks(edges, 5)]).select("id", "value")


_NUMBER = rf"[0-9]|%|(?i:\b(?:{evidence.NUMBER_WORDS})\b)|(?i:\b(?:um|uma)\s+(?:{evidence.COUNTED_WORDS})\b)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, body, facts: each conversation as a response whose turns are claims that cite their roles, whole texts; some are broken by their number."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    told = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kind = lambda t: F.when(t["turn"] % 2 == 0, "observacao").otherwise("hipotese").alias("type")
    plain = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.array(t["role"]).alias("citations"), kind(t)))
    scored = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.array(t["role"]).alias("citations"), kind(t), F.lit(1).alias("score")))
    body, way = F.to_json(F.struct(plain.alias("claims"))), F.col("conv_id") % 11
    broken = F.when(way == 3, F.to_json(F.struct(scored.alias("claims")))).when(way == 5, F.concat(body, F.lit("}"))).when(way == 7, F.to_json(F.struct(plain.alias("claims"), F.lit("x").alias("note")))).when(way == 9, "").otherwise(body)
    return told.select("conv_id", broken.alias("body"), F.array(F.lit("user"), F.lit("assistant")).alias("facts"))


_GATED = f"""WITH claims AS (
  SELECT conv_id, turn, text, role, CASE WHEN turn % 2 = 0 THEN 'observacao' ELSE 'hipotese' END AS type, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM conversations
), judged AS (
  SELECT *, coalesce(units, 0) NOT BETWEEN 12 AND 360 OR role IS NULL AS bad, coalesce(role IN ('user', 'assistant'), false) AND NOT coalesce(regexp_matches(text, '{_NUMBER}'), false) AS fine FROM claims
), sums AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fine) AS fine, CASE WHEN conv_id % 11 = 9 THEN '{responses.NO_TEXT}' WHEN conv_id % 11 = 5 THEN '{responses.NO_JSON}'
    WHEN conv_id % 11 IN (3, 7) OR count(*) > 8 OR bool_or(bad) THEN '{evidence.ILL_FORMED}' END AS broken FROM judged GROUP BY conv_id
)"""


@query(_GATED + f""" SELECT conv_id, CASE WHEN broken IS NOT NULL THEN 0 ELSE least(fine, 4) END AS taken, CASE WHEN broken IS NOT NULL THEN 1 ELSE n - fine END AS rejected,
  coalesce(broken, CASE WHEN fine = 0 THEN '{evidence.ALL_REJECTED}' END) AS message FROM sums""")
def gate_report(spark, sf_dir):
    """How many claims of each response pass the gate, and what is said of the rest."""
    return responses.gated(_responses(spark, sf_dir), "body", "facts").select("conv_id", F.size("claims").alias("taken"), "rejected", "message")


@query(_GATED + """ SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, text, role AS citation, type FROM judged JOIN sums USING (conv_id) WHERE broken IS NULL AND judged.fine QUALIFY place < 4""")
def claim_gate(spark, sf_dir):
    """The claims that pass the gate."""
    out = responses.gated(_responses(spark, sf_dir), "body", "facts").select("conv_id", F.posexplode("claims").alias("place", "c"))
    return out.select("conv_id", "place", "c.text", F.get("c.citations", F.lit(0)).alias("citation"), "c.type")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response, place, name, arguments: each turn of a conversation as a call that its numbers choose; some are no JSON."""
    stage = lambda i: F.element_at(F.array(*map(F.lit, adapters.STAGES)), (i % 5 + 1).cast("int"))
    conv, turn = F.col("conv_id"), F.col("turn")
    way = (conv + turn) % 5
    name = F.when(way < 2, responses.INSPECT).when(way == 2, responses.COMPARE).when(way == 3, responses.RANK).otherwise("drop_tables")
    edge = F.when(conv % 7 == 0, "edge:none").otherwise(text_id("edge", stage(conv), stage(turn)))
    given = (
        F.when(way < 2, F.to_json(F.struct(edge.alias("edgeId")))).when(way == 2, F.to_json(F.struct(text_id("variant", stage(conv)).alias("leftId"), text_id("variant", stage(turn + 1)).alias("rightId"))))
        .otherwise(F.to_json(F.struct((turn % 7).alias("limit"))))
    )
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(conv.alias("response"), turn.alias("place"), name.alias("name"), F.when(conv % 13 == 0, F.concat(given, F.lit(","))).otherwise(given).alias("arguments"))


_STAGE = lambda i: f"(['signup', 'view', 'click', 'purchase', 'error'])[({i}) % 5 + 1]"
_AUDIT = EDGES + VARIANTS[len(SESSION):] + f""", efact AS (SELECT edge_id, n, median, left('tool-' || edge_id, 40) AS id, 'mediana ' || {_pt('median')} || ' dias' AS value, row_number() OVER (ORDER BY median DESC, n DESC, edge_id) AS place FROM named),
numbered AS (
  SELECT conv_id, turn, (conv_id + turn) % 5 AS way, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, 'edge:' || {hash_sql(_STAGE('conv_id') + " || chr(31) || " + _STAGE('turn'))} AS e,
    'variant:' || {hash_sql(_STAGE('conv_id'))} AS l, 'variant:' || {hash_sql(_STAGE('turn + 1'))} AS r FROM conversations
), run AS (
  SELECT *, CASE WHEN way < 2 THEN '{responses.INSPECT}' WHEN way = 2 THEN '{responses.COMPARE}' WHEN way = 3 THEN '{responses.RANK}' ELSE 'drop_tables' END AS tool FROM numbered WHERE sequence <= 3
), told AS (
  SELECT run.*, efact.id AS eid, efact.value AS evalue, vl.lead_n AS ln, vr.lead_n AS rn, CASE WHEN conv_id % 13 = 0 THEN '{responses.NO_ARGUMENTS}' WHEN way = 4 OR way = 3 AND turn % 7 NOT BETWEEN 1 AND 5 THEN tool || ' does not take these arguments'
    WHEN way = 2 AND l = r THEN '{responses.SAME_VARIANT}' WHEN way < 2 AND efact.id IS NULL THEN '{responses.NO_EDGE}' WHEN way = 2 AND (vl.lead_n IS NULL OR vr.lead_n IS NULL) THEN '{responses.NO_VARIANT}' END AS reason
  FROM run LEFT JOIN efact ON efact.edge_id = e AND conv_id % 7 <> 0 LEFT JOIN vnamed vl ON vl.variant_id = l LEFT JOIN vnamed vr ON vr.variant_id = r
)"""


@query(_AUDIT + f""" SELECT conv_id AS response, sequence, tool, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
  CASE WHEN reason IS NOT NULL THEN '' WHEN way < 2 THEN eid WHEN way = 2 THEN left('tool-left-' || l, 40) || ',' || left('tool-right-' || r, 40) ELSE (SELECT string_agg(id, ',' ORDER BY place) FROM efact WHERE place <= turn % 7) END AS evidence_ids,
  CASE WHEN reason IS NOT NULL THEN '' WHEN way < 2 THEN evalue WHEN way = 2 THEN {_COUNT('ln')} || ' casos,' || {_COUNT('rn')} || ' casos' ELSE (SELECT string_agg(value, ',' ORDER BY place) FROM efact WHERE place <= turn % 7) END AS shown FROM told""")
def tool_audit(spark, sf_dir):
    """All calls of all responses in one plan: what was taken, what was refused and why, and the facts that were told."""
    edges, variants = rounded(_named_edges(spark, sf_dir)), rounded(_variants(spark, sf_dir)).withColumn("variant_id", text_id("variant", F.col("path_key")))
    out = responses.answered(_calls(spark, sf_dir), edges, variants)
    shown = lambda c: F.array_join(F.transform("facts", lambda f: f[c]), ",")
    return out.select("response", "sequence", "tool", "status", "reason", shown("id").alias("evidence_ids"), shown("value").alias("shown"))


# ---- sources and sinks


@query(SESSION + """ SELECT case_id, activity, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((ts_ms % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, resource, 'unknown' AS lifecycle FROM log""")
def csv_export(spark, sf_dir):
    return files.csv_frame(_log(spark, sf_dir))


@query(SESSION + """, e AS (SELECT case_id, seq, '    <event>' || chr(10) || '      <string key="concept:name" value="' || activity || '"/>' || chr(10) || '      <date key="time:timestamp" value="' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.')
  || lpad((ts_ms % 1000)::VARCHAR, 3, '0') || 'Z"/>' || chr(10) || '      <string key="org:resource" value="' || resource || '"/>' || chr(10) || '    </event>' AS event FROM log)
SELECT '  <trace>' || chr(10) || '    <string key="concept:name" value="' || case_id || '"/>' || chr(10) || string_agg(event, chr(10) ORDER BY seq) || chr(10) || '  </trace>' AS value FROM e GROUP BY case_id""")
def xes_export(spark, sf_dir):
    return files.xes_traces(_log(spark, sf_dir))


_ODD = """activity || ', "' || resource || '";' || chr(10) || '!'"""
_STAMP = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((ts_ms % 1000)::VARCHAR, 3, '0') || 'Z'"


@query(SESSION + f" SELECT case_id, {_ODD} AS activity, {_STAMP} AS timestamp, resource, 'unknown' AS lifecycle FROM log")
def csv_read(spark, sf_dir):
    """A CSV file with separators, quotes and line ends in its fields, written and read again."""
    odd = F.concat("activity", F.lit(', "'), "resource", F.lit('";\n!'))
    path = scratch_path(spark, "csv")
    files.write_csv(_log(spark, sf_dir).withColumn("activity", odd), path)
    return files.read_raw(spark, path).select("case_id", "activity", "timestamp", "resource", "lifecycle")


@query(SESSION + f" SELECT case_id, activity || ' & <' || resource || '>' AS activity, {_STAMP} AS timestamp, resource FROM log")
def xes_read(spark, sf_dir):
    """XES files with entities, written and read again."""
    path = scratch_path(spark, "xes")
    files.write_xes(_log(spark, sf_dir).withColumn("activity", F.concat("activity", F.lit(" & <"), "resource", F.lit(">"))), path)
    return files.raw_xes(spark, path).select("case_id", "activity", "timestamp", "resource")


@query(SESSION + " SELECT DISTINCT case_id, activity, ts_ms, resource FROM log")
def log_read(spark, sf_dir):
    """The clean log of a folder that has half of the cases as CSV and half as XES."""
    log, path = written(_log(spark, sf_dir), "log"), scratch_path(spark, "logs")
    half = F.crc32(F.col("case_id").cast("binary")) % 2 == 0
    files.write_csv(log.where(half), f"{path}/csv")
    files.write_xes(log.where(~half), f"{path}/xes")
    return files.read_log(spark, f"{path}/*").select("case_id", "activity", "ts_ms", "resource")


@query("SELECT DISTINCT 'k' || (event_id % 4) AS name FROM events WHERE event_id % 4 <> 2")
def attribute_names(spark, sf_dir):
    key = F.concat(F.lit("k"), (F.col("seq") % 4).cast("string"))
    log = _log(spark, sf_dir).withColumn("attributes", F.when(F.col("seq") % 4 != 2, F.create_map(key, F.lit("x"))))
    return files.attribute_names(log)


@query("SELECT event_id, lower(strip_accents(event_type)) AS name FROM events")
def header_folding(spark, sf_dir):
    """Names of columns as they are compared: no case, no accents, nothing but letters, digits, colon and underscore."""
    accented = F.translate(F.upper("event_type"), "AEIOU", "ÁÉÍÔÜ")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text_functions.folded(F.concat(F.lit(" "), accented, F.lit("?"))).alias("name"))
