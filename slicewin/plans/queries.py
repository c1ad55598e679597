"""The windows' queries over ``events``, with SQL for each."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.functions import aggregates as A
from slicewin.functions.time import millis
from slicewin.operators import windows as W
from slicewin.plans.planner import aggregate_windows
from slicewin.sources import connectors
from slicewin.streaming.lateness import drop_late
from slicewin.streaming.stateful import stream_stateful
from slicewin.streaming.windows import stream_windows, use_rocksdb

H, D = W.HOUR, W.DAY
#: 2024-01-01, 2024-01-05 and 2024-01-20 in milliseconds.
FIRST, FIFTH, TWENTIETH = 1_704_067_200_000, 1_704_412_800_000, 1_705_708_800_000
#: Windows that share few edges.
UNRELATED = [(7_001_000, 7_001_000), (25_003_000, 25_003_000), (36_000_000, 10_800_000), (17_000_000, 29_000_000), (86_400_000, 14_399_000)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return e.select("event_id", "user_id", "event_type", "props", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))


def _four() -> list[A.Aggregate]:
    return [A.sum_of("cents"), A.count_rows(), A.min_of("cents"), A.max_of("cents")]


def _query(windows, aggregates=_four, keys=("user_id",), **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate_windows(events(spark, sf_dir), windows() if callable(windows) else windows, aggregates(), keys=list(keys), order=["event_id"], **more)

    return run


def _sum() -> list[A.Aggregate]:
    return [A.sum_of("cents"), A.count_rows()]


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive up to 99 minutes late; those more than an hour behind the newest before them are dropped."""
    rows = events(spark, sf_dir)
    rows = rows.withColumn("arrival", millis(F.col("ts"), "timestamp_ntz") + F.col("event_id") * 7919 % 100 * W.MINUTE)
    return aggregate_windows(rows, [W.Tumbling(6 * H)], _sum(), keys=["user_id"], late=drop_late("arrival", H))


def _weeks(t):
    start = t - F.pmod(t - 4 * D, F.lit(7 * D))
    return F.array(F.struct(start.alias("start"), (start + 7 * D).alias("end")), F.struct(start.alias("start"), (start + 5 * D).alias("end")))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar weeks and their first five days; rows of the last two days are in the week alone."""
    assign = lambda t: F.filter(_weeks(t), lambda w: w["end"] > t)
    return aggregate_windows(events(spark, sf_dir), [W.UserDefined(assign)], _sum(), keys=["event_type"])


def _days_from_first(rows):
    """Windows of a day that open at the first row not in the one before."""
    out = []
    for t in rows["time"]:
        if not out or t >= out[-1][1]:
            out.append((t, t + D))
    return out


def _geometric(values) -> float:
    return math.floor(math.exp(sum(math.log(v + 1) for v in sorted(values)) / len(values)) * 100) / 100


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    x = x.select("l_returnflag", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return aggregate_windows(x, [W.Tumbling(30 * D)], _sum(), time="l_shipdate", keys=["l_returnflag"])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    x = x.select("o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return aggregate_windows(x, [W.Sliding(90 * D, 30 * D)], _four(), time="o_orderdate", keys=["o_orderpriority"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the order of turns, which have no time."""
    x = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    x = x.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return aggregate_windows(x, [W.CountTumbling(2)], [A.sum_of("n"), A.max_of("n")], time="turn", keys=["conv_id"], order=["n"])


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='slicewin-')}"


def _stream(build):
    """All of ``events`` through a stream into files, which are read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir.rstrip('/')}/events.parquet"
        # As a pattern, since a stream takes a single file for a folder otherwise.
        rows = connectors.from_files(spark, path.replace("events", "event[s]"), spark.read.parquet(path).schema)
        ts = F.timestamp_millis(millis(F.col("ts"), "timestamp_ntz"))
        results = build(rows.select("event_id", "user_id", "event_type", ts.alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents")))
        out = f"{_shared(spark).rstrip('/')}/slicewin/stream-{uuid.uuid4().hex}"
        connectors.to_files(results, f"{out}/rows", f"{out}/state", once=True).awaitTermination()
        return spark.read.schema(results.schema).parquet(f"{out}/rows")

    return run


def _stateful(window, folds, keys):
    def build(rows: DataFrame) -> DataFrame:
        use_rocksdb(rows.sparkSession)
        return stream_stateful(rows, window(), folds, keys=keys, lateness=0, tie="event_id")

    return _stream(build)


def queries() -> dict:
    first = FIRST
    return {
        "window_tumbling": _query([W.Tumbling(6 * H)]),
        "window_sliding": _query([W.Sliding(24 * H, 6 * H)]),
        "window_session": _query([W.Session(8 * H)]),
        "window_session_global": _query([W.Session(5 * W.MINUTE)], keys=()),
        "window_fixed_band": _query([W.FixedBand(first + 24 * H, 72 * H)]),
        "window_punctuation": _query(lambda: [W.Punctuation(F.col("event_type") == "error")]),
        "window_count_tumbling": _query([W.CountTumbling(10)]),
        "window_count_sliding": _query([W.CountSliding(20, 5)]),
        "window_count_global": _query([W.CountTumbling(100)], keys=()),
        "window_concurrent": _query([W.Tumbling(H), W.Tumbling(6 * H), W.Sliding(12 * H, 3 * H)], keys=()),
        "aggregate_mean": _query([W.Tumbling(24 * H)], lambda: [A.integer_mean_of("cents", "mean_int"), A.mean_of("cents")]),
        "aggregate_quantile": _query([W.Tumbling(24 * H)], lambda: [A.quantile_of("cents", 0.5, "median"), A.quantile_of("cents", 0.9, "p90")], ()),
        "window_tumbling_global": _query([W.Tumbling(H)], keys=()),
        "window_include_empty": _query([W.Tumbling(H), W.Sliding(3 * H, 2 * H)], _sum, include_empty=True),
        "window_sliding_uneven": _query([W.Sliding(10 * H, 3 * H)], keys=("event_type",)),
        "window_sliding_gaps": _query([W.Sliding(H, 5 * H)], keys=("event_type",)),
        "window_unrelated": _query([W.Sliding(*w) for w in UNRELATED], keys=("event_type",)),
        "window_sessions_of_two_gaps": _query([W.Session(2 * H), W.Session(6 * H)]),
        "window_session_hours": _query([W.Session(H)], lambda: [A.quantile_of("cents", 0.5, "median"), A.count_rows()]),
        "window_fixed_band_two": _query([W.FixedBand(FIFTH, 3 * D), W.FixedBand(FIFTH + 2 * D, 3 * D)], keys=("event_type",)),
        "window_count_two": _query([W.CountTumbling(3), W.CountTumbling(5)], _sum),
        "window_punctuation_regex": _query(lambda: [W.Punctuation(W.pattern(props=r'\{"k": 9.*', event_type=None))], _sum, ("event_type",)),
        "window_punctuation_two": _query(lambda: [W.Punctuation(W.pattern(event_type="err.*", user_id=7)), W.Punctuation(F.col("cents") < 100)], _sum, ()),
        "window_added": _query([W.Tumbling(6 * H), W.Added(W.Tumbling(4 * H), TWENTIETH)], _sum, ("event_type",)),
        "window_concurrent_all": _query(lambda: [W.Tumbling(6 * H), W.Session(3 * H), W.CountTumbling(10), W.FixedBand(FIFTH, 3 * D), W.Punctuation(F.col("event_type") == "error")], _sum),
        "window_user_defined": _weekly,
        "window_user_context": _query([W.UserContext(_days_from_first)], _sum),
        "watermark": _query([W.Tumbling(6 * H), W.Session(3 * H), W.CountTumbling(10)], _sum, watermark=TWENTIETH),
        "lateness_drop": _late,
        "aggregate_quantile_shared": _query([W.Sliding(D, 6 * H), W.Tumbling(6 * H)], lambda: [A.shared_quantile_of("cents", 1, 2, "median"), A.shared_quantile_of("cents", 9, 10, "p90"), A.count_rows()], ("event_type",)),
        "aggregate_reduce_ordered": _query([W.Tumbling(6 * H)], lambda: [A.reduce_of("cents", "event_id", lambda a, b: a - b)]),
        "aggregate_custom": _query([W.Sliding(12 * H, 4 * H)], lambda: [A.custom("spread", (F.max("cents"), F.min("cents")), (F.max, F.min), lambda hi, lo: hi - lo)]),
        "aggregate_pandas": _query([W.Tumbling(6 * H)], lambda: [A.pandas_of(["cents"], _geometric, "double", "geometric")]),
        "tpch_revenue": _revenue,
        "tpch_orders": _orders,
        "conversation_turns": _turns,
        "stream_tumbling": _stream(lambda rows: stream_windows(rows, [W.Tumbling(6 * H)], _sum(), keys=["user_id"], lateness=0)),
        "stream_session": _stream(lambda rows: stream_windows(rows, [W.Session(3 * H)], _sum(), keys=["user_id"], lateness=0)),
        "stream_union": _stream(lambda rows: stream_windows(rows, [W.Tumbling(H), W.Sliding(6 * H, 2 * H), W.Sliding(H, 5 * H), W.FixedBand(FIFTH, 3 * D), W.Session(5 * W.MINUTE)], _sum(), lateness=0)),
        "stream_punctuation": _stateful(lambda: W.Punctuation(F.col("event_type") == "error"), [("cents", A.fold_sum()), ("cents", A.fold_count())], ["user_id"]),
        "stream_count": _stateful(lambda: W.CountSliding(20, 5), [("cents", A.fold_sum()), ("cents", A.fold_quantile(1, 2, "median"))], ["user_id"]),
    }


_E = "e AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) // 1000 AS ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
_S = "CAST(sum(cents) AS BIGINT) AS sum, count(*) AS count"
_A = f"{_S}, min(cents) AS min, max(cents) AS max"


def _of(keys):
    return (f"PARTITION BY {keys}", f"{keys}, ") if keys else ("", "")


def _tumbling(spec, size, keys, values=_A, source="e"):
    return f'SELECT {spec} AS spec, {_of(keys)[1]}ts - ts % {size} AS start, ts - ts % {size} + {size} AS "end", {values} FROM {source} GROUP BY ALL'


def _sliding(spec, size, slide, keys, values=_A, source="e", at="ts", full=""):
    first = f"greatest(0, {at} - {at} % {slide} - {(size - 1) // slide * slide})"
    return f'SELECT {spec} AS spec, {_of(keys)[1]}start, start + {size} AS "end", {values} FROM (SELECT *, unnest(range({first}, {at} + 1, {slide})) AS start FROM {source}) WHERE start + {size} > {at} {full} GROUP BY ALL'


def _session(spec, gap, keys, values=_A):
    p, k = _of(keys)
    return f'SELECT {spec} AS spec, {k}min(ts) AS start, max(ts) + {gap} AS "end", {values} FROM (SELECT *, sum(new) OVER ({p} ORDER BY ts) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER ({p} ORDER BY ts) <= {gap} THEN 0 ELSE 1 END AS new FROM e)) GROUP BY {k}sid'


def _counted(spec, size, slide, keys, values=_A, source="e"):
    p, k = _of(keys)
    ranked = f"(SELECT *, row_number() OVER ({p} ORDER BY ts, event_id) - 1 AS rank, count(*) OVER ({p}) AS total FROM {source})"
    return _sliding(spec, size, slide, keys, values, ranked, "rank", f"AND start + {size} <= total")


def _band(spec, start, size, keys, values=_A):
    return f'SELECT {spec} AS spec, {_of(keys)[1]}{start} AS start, {start + size} AS "end", {values} FROM e WHERE ts >= {start} AND ts < {start + size} GROUP BY ALL'


def _punctuation(spec, mark, keys, values=_A):
    p, k = _of(keys)
    starts = f"SELECT *, coalesce(max(CASE WHEN {mark} THEN ts END) OVER ({p} ORDER BY ts), min(ts) OVER ({p})) AS start FROM e"
    return f'SELECT spec, {k}start, "end", * EXCLUDE (spec, {k}start, "end") FROM (SELECT *, lead(start) OVER ({p} ORDER BY start) AS "end" FROM (SELECT {spec} AS spec, {k}start, {values} FROM ({starts}) GROUP BY ALL)) WHERE "end" IS NOT NULL'


def _all(*parts):
    return f"WITH {_E} " + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _filled(spec, size, slide, keys):
    """With empty windows from the first to the last of each key."""
    grid = f"SELECT {keys}, unnest(range(greatest(0, min(ts) - min(ts) % {slide} - {(size - 1) // slide * slide}), max(ts) + 1, {slide})) AS start, min(ts) AS lo FROM e GROUP BY {keys}"
    return f'SELECT {spec} AS spec, g.{keys}, g.start, g.start + {size} AS "end", f.sum, coalesce(f.count, 0) AS count FROM ({grid}) g LEFT JOIN ({_sliding(spec, size, slide, keys, _S)}) f ON f.{keys} = g.{keys} AND f.start = g.start WHERE g.start + {size} > g.lo'


def oracle_sql() -> dict[str, str]:
    types, top = "event_type", f"(SELECT max(ts) FROM e)"
    upto = f"(SELECT * FROM e WHERE ts <= {TWENTIETH})"
    late = f"(SELECT * FROM (SELECT *, max(ts) OVER (ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT *, ts + event_id * 7919 % 100 * 60000 AS arrival FROM e)) WHERE seen IS NULL OR ts >= seen - {H})"
    week = f"ts - (ts - {4 * D}) % {7 * D}"
    reduced = "list_reduce(list(cents ORDER BY event_id), lambda a, b: a - b) AS reduce"
    days = f"""WITH RECURSIVE {_E}, f AS (SELECT user_id, min(ts) AS start FROM e GROUP BY user_id UNION ALL
        SELECT f.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts >= f.start + {D}) FROM f WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = f.user_id AND e.ts >= f.start + {D}))
        SELECT 0 AS spec, f.user_id, f.start, f.start + {D} AS "end", {_S} FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.start AND e.ts < f.start + {D} GROUP BY ALL"""
    halves = "quantile_disc(cents, 0.5) AS median, quantile_disc(cents, 0.9) AS p90, count(*) AS count"
    orders = "e AS (SELECT o_orderpriority, epoch_us(o_orderdate) // 1000 AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
    lines = "e AS (SELECT l_returnflag, epoch_us(l_shipdate) // 1000 AS ts, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"
    turns = "(SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) - 1 AS rank, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE turn IS NOT NULL)"
    return {
        "window_tumbling": _all(_tumbling(0, 6 * H, "user_id")),
        "window_sliding": _all(_sliding(0, 24 * H, 6 * H, "user_id")),
        "window_session": _all(_session(0, 8 * H, "user_id")),
        "window_session_global": _all(_session(0, 5 * W.MINUTE, "")),
        "window_fixed_band": _all(_band(0, FIRST + D, 3 * D, "user_id")),
        "window_punctuation": _all(_punctuation(0, "event_type = 'error'", "user_id")),
        "window_count_tumbling": _all(_counted(0, 10, 10, "user_id")),
        "window_count_sliding": _all(_counted(0, 20, 5, "user_id")),
        "window_count_global": _all(_counted(0, 100, 100, "")),
        "window_concurrent": _all(_tumbling(0, H, ""), _tumbling(1, 6 * H, ""), _sliding(2, 12 * H, 3 * H, "")),
        "aggregate_mean": _all(_tumbling(0, D, "user_id", "CAST(sum(cents) AS BIGINT) // count(*) AS mean_int, CAST(sum(cents) AS DOUBLE) / count(*) AS mean")),
        "aggregate_quantile": _all(_tumbling(0, D, "", "CAST(quantile_disc(cents, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(cents, 0.9) AS DOUBLE) AS p90")),
        "window_tumbling_global": _all(_tumbling(0, H, "")),
        "window_include_empty": _all(_filled(0, H, H, "user_id"), _filled(1, 3 * H, 2 * H, "user_id")),
        "window_sliding_uneven": _all(_sliding(0, 10 * H, 3 * H, types)),
        "window_sliding_gaps": _all(_sliding(0, H, 5 * H, types)),
        "window_unrelated": _all(*[_sliding(i, *w, types) for i, w in enumerate(UNRELATED)]),
        "window_sessions_of_two_gaps": _all(_session(0, 2 * H, "user_id"), _session(1, 6 * H, "user_id")),
        "window_session_hours": _all(_session(0, H, "user_id", "CAST(quantile_disc(cents, 0.5) AS DOUBLE) AS median, count(*) AS count")),
        "window_fixed_band_two": _all(_band(0, FIFTH, 3 * D, types), _band(1, FIFTH + 2 * D, 3 * D, types)),
        "window_count_two": _all(_counted(0, 3, 3, "user_id", _S), _counted(1, 5, 5, "user_id", _S)),
        "window_punctuation_regex": _all(_punctuation(0, """regexp_full_match(props, '\\{"k": 9.*')""", types, _S)),
        "window_punctuation_two": _all(_punctuation(0, "regexp_full_match(event_type, 'err.*') AND user_id = 7", "", _S), _punctuation(1, "cents < 100", "", _S)),
        "window_added": _all(_tumbling(0, 6 * H, types, _S), f"SELECT * FROM ({_tumbling(1, 4 * H, types, _S)}) WHERE start >= {TWENTIETH}"),
        "window_concurrent_all": _all(
            _tumbling(0, 6 * H, "user_id", _S), _session(1, 3 * H, "user_id", _S), _counted(2, 10, 10, "user_id", _S), _band(3, FIFTH, 3 * D, "user_id", _S), _punctuation(4, "event_type = 'error'", "user_id", _S)
        ),
        "window_user_defined": _all(f'SELECT 0 AS spec, event_type, {week} AS start, {week} + {7 * D} AS "end", {_S} FROM e GROUP BY ALL', f'SELECT 0 AS spec, event_type, {week} AS start, {week} + {5 * D} AS "end", {_S} FROM e WHERE {week} + {5 * D} > ts GROUP BY ALL'),
        "window_user_context": days,
        "watermark": _all(
            f'SELECT * FROM ({_tumbling(0, 6 * H, "user_id", _S)}) WHERE "end" <= {TWENTIETH}', f'SELECT * FROM ({_session(1, 3 * H, "user_id", _S)}) WHERE "end" < {TWENTIETH}', _counted(2, 10, 10, "user_id", _S, upto)
        ),
        "lateness_drop": _all(_tumbling(0, 6 * H, "user_id", _S, late)),
        "aggregate_quantile_shared": _all(_sliding(0, D, 6 * H, types, halves), _tumbling(1, 6 * H, types, halves)),
        "aggregate_reduce_ordered": _all(_tumbling(0, 6 * H, "user_id", reduced)),
        "aggregate_custom": _all(_sliding(0, 12 * H, 4 * H, "user_id", "max(cents) - min(cents) AS spread")),
        "aggregate_pandas": _all(_tumbling(0, 6 * H, "user_id", "floor(exp(list_sum(list(ln(CAST(cents + 1 AS DOUBLE)) ORDER BY cents)) / count(*)) * 100) / 100 AS geometric")),
        "tpch_revenue": f"WITH {lines} " + _tumbling(0, 30 * D, "l_returnflag", _S),
        "tpch_orders": f"WITH {orders} " + _sliding(0, 90 * D, 30 * D, "o_orderpriority"),
        "conversation_turns": _sliding(0, 2, 2, "conv_id", "CAST(sum(n) AS BIGINT) AS sum, max(n) AS max", turns, "rank", "AND start + 2 <= total"),
        "stream_tumbling": _all(f'SELECT * FROM ({_tumbling(0, 6 * H, "user_id", _S)}) WHERE "end" <= {top}'),
        "stream_session": _all(f'SELECT * FROM ({_session(0, 3 * H, "user_id", _S)}) WHERE "end" <= {top}'),
        "stream_union": _all(
            f'SELECT * FROM ({_tumbling(0, H, "", _S)}) WHERE "end" <= {top}',
            f'SELECT * FROM ({_sliding(1, 6 * H, 2 * H, "", _S)}) WHERE "end" <= {top}',
            f'SELECT * FROM ({_sliding(2, H, 5 * H, "", _S)}) WHERE start + {5 * H} <= {top}',
            _band(3, FIFTH, 3 * D, "", _S),
            f'SELECT * FROM ({_session(4, 5 * W.MINUTE, "", _S)}) WHERE "end" <= {top}',
        ),
        "stream_punctuation": f"WITH {_E} SELECT * EXCLUDE (spec) FROM (" + _punctuation(0, "event_type = 'error'", "user_id", _S) + f') WHERE "end" < {top}',
        "stream_count": f"WITH {_E} SELECT * EXCLUDE (spec) FROM (" + _counted(0, 20, 5, "user_id", "CAST(sum(cents) AS BIGINT) AS sum, quantile_disc(cents, 0.5) AS median", f"(SELECT * FROM e WHERE ts < {top})") + ")",
    }
