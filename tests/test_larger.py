"""What showed on larger tables only, on small ones that are made to show it."""

import datetime
import itertools
import random

import duckdb

from pyspark.sql import functions as F

from flowloom.functions import quantiles
from flowloom.operators import analysis, conformance, evidence, profile, ranking, traces
from flowloom.plans.catalogue import ORACLES, QUERIES
from flowloom.sources import files, scratch
from flowloom.sources.scratch import written

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    """Two leads whose distance from the median is 0.0039475 and a little less: SQL tells 0.003947 of both, so that their ids decide."""
    rows = []
    for user, (lead, *path) in enumerate([(3_941_064, "click", "view"), (3_941_064 - 43, "view", "click"), (3_600_000, "view", "view"), (0, "error"), (0, "signup")]):
        for i, activity in enumerate(path):
            rows.append((len(rows), START + datetime.timedelta(milliseconds=i * lead), user, activity, 1.0, '{"k": 1}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").selectExpr("* except (ts)", "ts::timestamp_ntz as ts").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("variant_rank", "variant_stats"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(ORACLES[name]).select(*(f'"{c}"' for c in got.columns)).fetchall())


def test_pairs_of_bags_are_dealt_into_as_many_tasks_as_they_want(spark, monkeypatch):
    """Rows of one token go to many cells, every pair meets once, and the tasks follow the pairs and not the bytes."""
    monkeypatch.setattr(conformance, "CELL", 4)
    monkeypatch.setattr(conformance, "PAIRS", 20)
    monkeypatch.setattr(conformance, "REFERENCES", 100)
    probe = spark.range(30).selectExpr("id % 2 AS token", "id")
    index = spark.range(40).selectExpr("id % 4 AS token", "id AS ref_id")
    a, b, tasks = conformance._cells(probe, index)
    assert tasks == 15 and a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 15
    met = a.join(b, ["token", "row", "column"])
    assert met.count() == met.select("id", "ref_id").distinct().count() == 300
    assert met.groupBy("token", "row", "column").count().agg({"count": "max"}).first()[0] < 80
    r = random.Random(4)
    paths = sorted({"".join(r.choices("abcd", k=r.randrange(1, 14))) for _ in range(160)})
    rows = [("\x1f".join(p), list(p), str(i)) for i, p in enumerate(paths)]
    held, known = rows[::4], [x for i, x in enumerate(rows) if i % 4]
    schema = "path_key string, path array<string>, case_id string"
    got = conformance.nearest_variants(spark.createDataFrame(held, schema), spark.createDataFrame(known, schema))
    cost = lambda p, q: len(p) + len(q) - 2 * conformance.lcs_length(conformance.bit_masks(p), len(p), q)
    want = {k: min((cost(p, q), kq) for kq, q, _ in known) for k, p, _ in held}
    assert {x["path_key"]: (x["cost"], "\x1f".join(x["reference"])) for x in got.collect()} == want


def test_what_is_read_twice_is_made_once(spark, tmp_path, monkeypatch):
    """Records of CSV files, the clean log, the leads of variants and the two that are compared: each is stored before it is read again."""
    made = []
    for module in (files, evidence, profile):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or written(df, name))
    (tmp_path / "a.csv").write_text('case_id,activity,timestamp\n1,"x\ny",2026-01-01\n1,z,2026-01-02\n2,z,2026-01-03\n')
    log = files.read_log(spark, f"{tmp_path}/a.csv")
    assert log.count() == 3 and {"cells", "clean"} <= set(made)
    variants = profile.variant_stats(traces.traces(log)).withColumn("variant_id", F.col("path_key"))
    assert evidence.compare_variants(variants, "z", "x\ny\x1fz").count() == 2 and made[-2:] == ["leads", "compared"]


def test_pairs_of_paths_do_not_travel(spark, monkeypatch):
    """Permutations of one bag: every held-out path is compared with every known one, and tasks get each path about once and not once a pair."""
    paths = ["".join(p) for p in itertools.permutations("abcdef")]
    rows = [("\x1f".join(p), list(p), str(i)) for i, p in enumerate(paths)]
    schema = "path_key string, path array<string>, case_id string"
    got_bytes, verify = spark.sparkContext.accumulator(0), conformance._verify

    def counted(batches):
        for b in batches:
            got_bytes.add(b.nbytes)
            yield b

    monkeypatch.setattr(conformance, "_verify", lambda batches: verify(counted(batches)))
    found = conformance.nearest_variants(spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1::2], schema)).collect()
    assert len(found) == 360 and {x["cost"] for x in found} == {2} and min(x["verified"] for x in found) == 360
    assert 720 * 20 < got_bytes.value < 720 * 300


def test_metrics_of_an_analysis_store_what_they_read(spark, make_log, monkeypatch):
    """The events are read for the cases alone, and of the rounds of the search only the last one's result stays."""
    made = []
    for module in (analysis, conformance, profile, quantiles, ranking, traces):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    r = random.Random(3)
    log = make_log([(f"n-{i}", [r.choice("abcde") for _ in range(r.randrange(1, 12))], [1]) for i in range(60)])
    before = set(scratch._MADE.get(spark.sparkContext.applicationId, []))
    a = analysis.analyse(spark, log)
    assert a.metrics.first()["case_count"] == 60
    names = [x.scratch_path.rsplit("/", 1)[1] for x in made]
    assert names.count("nearest") > 1 and not {"log", "leads", "to_rank", "ranges"} & {*names} and names.count("counted") == 1
    left = [p.rsplit("/", 1)[1] for p in scratch._MADE[spark.sparkContext.applicationId] if p not in before]
    assert left.count("nearest") == 1 and not {"met", "reach", "references"} & {*left}
    assert a.edges.count() and a.header.count() == a.trend.count() == 1  # the other parts are made when asked for


def test_long_and_short_paths_compare_alike():
    """In a piece of one bag and in tasks: paths of less than 64 activities go by vectors, longer ones one by one."""
    r = random.Random(9)
    for _ in range(40):
        bag = [r.choice("abcdefg") for _ in range(r.choice((1, 5, 62, 63, 64, 65, 130)))]
        known = ["\x1f".join(r.sample(bag, len(bag))) for _ in range(5)]
        refs = conformance._References([7, 3, 9, 1, 5], known)
        held = [[r.choice("abcdefgz") for _ in range(r.choice((1, 7, 61, 62, 63, 64, 65, 90)))] for _ in range(9)]
        best = {}
        refs.compare([*enumerate(held)], best)
        cost = lambda p, q: len(p) + len(q) - 2 * conformance.lcs_length(conformance.bit_masks(p), len(p), q)
        assert best == {i: (*min((cost(p, k.split("\x1f")), n) for n, k in zip([7, 3, 9, 1, 5], known)), 5) for i, p in enumerate(held)}
