import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from slicewin.bench import configurations, run
from slicewin.functions import aggregates as A
from slicewin.functions.time import at_millis, millis
from slicewin.operators import windows as W
from slicewin.plans import planner
from slicewin.plans.planner import aggregate_windows, edges
from slicewin.query import WindowedQuery
from slicewin.sources import connectors, generators


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def drawn(spark, n=2000, keys=4, until=5000, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(r.randrange(keys), r.randrange(100), r.randrange(until)) for _ in range(n)], "key int, value long, ts long").repartition(3)


def test_shared_slices_give_what_rows_give(spark):
    rows = drawn(spark)
    windows = [W.Sliding(10, 3), W.Sliding(10, 4), W.Tumbling(40), W.Tumbling(17), W.Sliding(60, 25), W.Sliding(5, 9), W.FixedBand(101, 333), W.Tumbling(1001), W.Tumbling(1038)]
    aggregates = [A.sum_of("value"), A.count_rows(), A.min_of("value"), A.max_of("value"), A.mean_of("value")]
    many = [W.Sliding(20 + 7 * i, 31 + 5 * i) for i in range(30)] + [W.FixedBand(50, 700)]
    same(aggregate_windows(rows, many, aggregates), aggregate_windows(rows, many, aggregates, share=False))
    for keys in ([], ["key"]):
        same(aggregate_windows(rows, windows, aggregates, keys=keys), aggregate_windows(rows, windows, aggregates, keys=keys, share=False))


def test_windows_of_spark_itself_give_the_same(spark):
    rows = generators.load(spark, 3000, 100, [(3000, 1500)], keys=2)
    windows = [W.Tumbling(1000), W.Sliding(3000, 1000), W.Sliding(2500, 700)]
    same(aggregate_windows(rows, windows, [A.sum_of("value")], keys=["key"]), run.bucketed(rows, windows, [A.sum_of("value")], ["key"]))


def test_quantiles_from_counts_are_exact(spark):
    rows = drawn(spark)
    windows = [W.Tumbling(50), W.Sliding(100, 30), W.FixedBand(10, 999), W.Session(3)]
    some = [A.shared_quantile_of("value", 1, 10, "a"), A.shared_quantile_of("value", 1, 2, "b"), A.count_rows(), A.shared_quantile_of("value", 9, 10, "c")]
    exact = [A.quantile_of("value", 0.1, "a"), A.quantile_of("value", 0.5, "b"), A.count_rows(), A.quantile_of("value", 0.9, "c")]
    whole = lambda df: df.select("spec", "key", "start", "end", *[F.col(c).cast("long") for c in ("a", "b", "count", "c")])
    same(whole(aggregate_windows(rows, windows, some, keys=["key"])), whole(aggregate_windows(rows, windows, exact, keys=["key"])))


def test_approximate_quantiles_are_near(spark):
    rows = drawn(spark, 5000)
    near = {r["start"]: r["quantile"] for r in aggregate_windows(rows, [W.Sliding(2000, 1000)], [A.approximate_quantile_of("value", 0.5)]).collect()}
    exact = {r["start"]: r["quantile"] for r in aggregate_windows(rows, [W.Sliding(2000, 1000)], [A.quantile_of("value", 0.5)]).collect()}
    assert near.keys() == exact.keys() and all(abs(near[k] - exact[k]) <= 5 for k in near)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_stretches_change_nothing(spark, monkeypatch, keys):
    """Sessions, ranks and punctuations over many short stretches."""
    rows = drawn(spark, 800, 2, 4000)
    windows = [W.Session(2), W.Session(9), W.CountTumbling(7), W.CountSliding(9, 4), W.CountSliding(3, 5), W.Punctuation(F.col("value") % 11 == 0)]
    aggregates = [A.sum_of("value"), A.count_rows()]
    whole = aggregate_windows(rows, windows, aggregates, keys=keys, order=["value"])
    want = sorted(map(repr, whole.collect()))
    monkeypatch.setattr(planner, "STRETCH", 3)
    monkeypatch.setattr(planner, "ROWS", 20)
    cut = aggregate_windows(rows, windows, aggregates, keys=keys, order=["value"])
    assert sorted(map(repr, cut.collect())) == want


@pytest.mark.parametrize("stretch", [50, 100_000])
def test_punctuations_go_through_rows_once(spark, monkeypatch, stretch):
    """A frame that ends with the partition, but does not begin with it, takes the square of its rows."""
    monkeypatch.setattr(planner, "ROWS", stretch)
    rows = drawn(spark, 600, 2, 400)
    out = aggregate_windows(rows, [W.Punctuation(F.col("value") < 20)], [A.sum_of("value"), A.count_rows()])
    held = [tuple(r) for r in rows.select("ts", "value").collect()]
    starts = sorted({t for t, v in held if v < 20} | {min(held)[0]})
    want = []
    for a, b in itertools.pairwise(starts):
        values = [v for t, v in held if a <= t < b]
        want.append((0, a, b, sum(values), len(values)))
    assert sorted(map(tuple, out.collect())) == want
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^)]+\(?\)?)\)", out._jdf.queryExecution().optimizedPlan().toString())
    assert frames and not [f for f in frames if "unboundedfollowing" in f[1] and "unboundedpreceding" not in f[0]]


def test_null_keys_and_times(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (3, 4, 3), (3, 8, None)], "key int, value long, ts long")
    windows = [W.Tumbling(10), W.Session(5), W.CountTumbling(1), W.FixedBand(0, 10)]
    out = aggregate_windows(rows, windows, [A.sum_of("value"), A.quantile_of("value", 0.5)], keys=["key"], include_empty=True)
    assert sorted(map(repr, out.where("spec <> 2").select("spec", "key", "sum").collect())) == sorted(f"Row(spec={s}, key={k}, sum={v})" for s in (0, 1, 3) for k, v in ((None, 3), (3, 4)))


def test_order_sensitive_aggregates_stay_off_slices():
    assert not A.Aggregate("x", (), (len,), len, order_sensitive=True).shares_slices


def test_pandas_aggregates(spark):
    rows = spark.createDataFrame([(2, 1), (8, 5), (5, 30)], "value long, ts long")
    out = aggregate_windows(rows, [W.Tumbling(10)], [A.pandas_of(["value", "ts"], lambda v, t: float((v * t).sum()), "double")])
    assert sorted(map(tuple, out.collect())) == [(0, 0, 10, 42.0), (0, 30, 40, 150.0)]


def test_folds_with_and_without_inverse():
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    for fold in (A.fold_sum(), A.fold_count(), A.fold_mean(), A.fold_min(), A.fold_max(), A.fold_quantile(1, 2)):
        for size, slide in ((3, 1), (4, 2), (2, 3)):
            assert fold.sliding(values, size, slide) == [fold.of(values[i : i + size]) for i in range(0, len(values) - size + 1, slide)]
    assert A.fold_sum().of([]) is None and A.fold_quantile(1, 2).of([4, 2, 9, 7]) == 4


def test_timestamps_are_milliseconds(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.123999' AS ntz, TIMESTAMP '2024-03-31 02:30:00.123999+00:00' AS ts, DATE '2024-03-31' AS d, 1711852200123 AS want")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        r = rows.select(millis(F.col("ntz"), "timestamp_ntz").alias("a"), millis(F.col("ts"), "timestamp").alias("b"), millis(F.col("d"), "date").alias("c"), "want").first()
        assert r.a == r.b == r.want and r.c == 1711843200000
        assert rows.where((F.col("ntz") >= at_millis(1711852200123, "timestamp_ntz")) & (F.col("ts") >= at_millis(1711852200123, "timestamp"))).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bands_reach_the_scan(spark, tmp_path):
    rows = spark.sql("SELECT id AS value, timestamp_millis(id * 1000) AS ts FROM range(1000)")
    rows.write.parquet(str(tmp_path / "t"))
    out = aggregate_windows(spark.read.parquet(str(tmp_path / "t")), [W.FixedBand(10_000, 5_000)], [A.sum_of("value")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and [tuple(r) for r in out.collect()] == [(0, 10_000, 15_000, 60)]


def test_plans_have_one_scan_and_one_explode_for_many_windows(spark, tmp_path):
    drawn(spark).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = aggregate_windows(rows, [W.Tumbling(100 + 7 * i) for i in range(100)], [A.sum_of("value")], keys=["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Union" not in plan


def test_edges_leave_out_what_finer_grids_hold():
    assert edges([W.Tumbling(3600), W.Tumbling(21600), W.Sliding(43200, 10800)]) == [(3600, 0)]
    assert edges([W.Sliding(10, 4), W.FixedBand(1, 2)]) == [(4, 0), (4, 2)]


def test_window_language():
    assert configurations.parse("Sliding(60000,250)") == [W.Sliding(60000, 250)]
    assert configurations.parse("Tumbling(2)") == [W.Tumbling(2000)] and configurations.parse(" Session(3) ") == [W.Session(3000)]
    drawn_ = configurations.parse("randomTumbling(1000,1,20)")
    assert len(drawn_) == 1000 and all(1000 <= w.size < 20000 for w in drawn_) and drawn_ == configurations.parse("randomTumbling(1000,1,20)")
    assert all(isinstance(w, W.CountTumbling) and 5 <= w.size < 9 for w in configurations.parse("randomCount(20,5,9)"))
    assert all(1000 <= w.gap < 4000 for w in configurations.parse("RandomSession(20,1,4)"))
    for wrong in ("Tumbling", "Sliding(1)", "Hopping(3)"):
        with pytest.raises(ValueError):
            configurations.parse(wrong)


def test_drawn_numbers_follow_the_published_rule():
    r = generators.JavaRandom(42)
    assert [r.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]  # fixed values of java.util.Random(42).nextInt(10)
    assert abs(generators.JavaRandom(42).share() - 0.7275636800328681) < 1e-15


def test_bench_configuration(spark):
    text = json.dumps({"name": "n", "runtime": 1, "throughput": 2000, "windowConfigurations": [["Sliding(1000,500)", "Tumbling(1)"]], "configurations": ["Slicing", "Bucket"], "sessionConfig": {"gapCount": 2, "minGapTime": 10, "maxGapTime": 20}, "aggFunctions": ["Sum", "Count"]})
    c = configurations.Configuration.read(text)
    assert len(c.gaps) == 2 and all(10 <= n < 20 for _, n in c.gaps)
    out = run.run(spark, c)
    assert [(r["plan"], r["aggregate"], r["windows"], r["rows"]) for r in out] == [(p, a, 2, 2000) for a in ("Sum", "Count") for p in ("Slicing", "Bucket")]
    t = run.Throughput()
    t.add(10, 2.0), t.add(30, 2.0)
    assert t.mean == 10.0 and run.Throughput.of_progress([{"numInputRows": 0, "processedRowsPerSecond": 0.0}, {"numInputRows": 3, "processedRowsPerSecond": 7.0}]).mean == 7.0


def test_generators(spark):
    rows = generators.load(spark, 100, 10, [(2000, 5000)])
    assert rows.where("ts >= 2000 AND ts < 7000").count() == 0 and rows.where("ts >= 7000").count() == 80
    late = generators.Disorder(30, 5, 9).of(rows, by="ts")
    delays = [r[0] for r in late.select(F.col("arrival") - F.col("ts")).collect()]
    assert set(delays) <= {0, 5, 6, 7, 8, 9} and 10 < sum(d > 0 for d in delays) < 60
    assert [tuple(r) for r in generators.counters(spark, 3, 2).collect()] == [(0, 1, 0), (1, 2, 1), (0, 3, 2)]
    assert generators.rate(spark).isStreaming and generators.rate_batches(spark).columns == ["key", "value", "ts"]


def test_connectors(spark, tmp_path):
    assert connectors.kafka_options("h:1", "t", "earliest", 5, **{"security.protocol": "SSL"}) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5", "kafka.security.protocol": "SSL"}
    raw = spark.createDataFrame([(bytearray(b"1"), bytearray(b"7")), (None, bytearray(b"x"))], "key binary, value binary").withColumn("timestamp", F.current_timestamp())
    assert [tuple(r) for r in connectors.decoded(raw).select("key", "value").collect()] == [(1, 7), (None, None)]
    results = spark.createDataFrame([(0, 5, 0, 10, 3, None)], "spec int, key int, start long, end long, sum long, mean double")
    assert [r.value for r in connectors.as_text(results).collect()] == ["[0,10) key=5 sum=3 mean=-"]
    m = connectors.as_messages(results, ["key"]).first()
    assert json.loads(m.key) == {"key": 5} and json.loads(m.value)["sum"] == 3
    assert connectors.with_time(spark.createDataFrame([(None,)], "ts timestamp"), "ts").where("ts IS NULL").count() == 0
    assert connectors.with_time(results, "at").columns[-1] == "at"


def test_console_sink(spark):
    query = connectors.to_console(generators.rate_batches(spark, 5).select("value"), "append", once=True)
    query.awaitTermination(60)
    assert query.exception() is None


def test_queries_are_values(spark):
    base = WindowedQuery().key("key").window(W.Tumbling(10)).aggregate(A.sum_of("value"))
    more = base.window(W.Tumbling(5), since=10).ordered("value").batch(watermark=20)
    rows = spark.createDataFrame([(1, 2, 3), (1, 4, 12), (2, 8, 25)], "key int, value long, ts long")
    assert sorted(map(tuple, rows.transform(base.over).collect())) == [(0, 1, 0, 10, 2), (0, 1, 10, 20, 4), (0, 2, 20, 30, 8)]
    assert sorted(map(tuple, rows.transform(more.over).collect())) == [(0, 1, 0, 10, 2), (0, 1, 10, 20, 4), (1, 1, 10, 15, 4)]
    stream = generators.rate(spark).transform(WindowedQuery().window(W.Tumbling(1000)).aggregate(A.count_rows()).allowed_lateness(5).over)
    assert stream.isStreaming and stream.columns == ["spec", "start", "end", "count"]
    with pytest.raises(ValueError):
        WindowedQuery().over(rows)
