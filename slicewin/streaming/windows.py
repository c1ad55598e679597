"""Windows over streams in Spark's own operators: watermarks drop what is too late, update mode refines what was given before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.functions.aggregates import Aggregate
from slicewin.functions.time import at_millis
from slicewin.operators.windows import Added, FixedBand, Session
from slicewin.plans.planner import is_timed


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps streams' state in RocksDB, which holds more than the heap and is needed for stateful windows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_windows(rows: DataFrame, windows: list, aggregates: list[Aggregate], time: str = "ts", keys: list[str] = (), lateness: int = 1_000) -> DataFrame:
    """As ``aggregate_windows``, for a stream whose ``time`` is a timestamp; sizes, lateness, start and end in milliseconds.

    Tumbling, sliding (also with gaps), session and band windows; others are stateful (``stream_stateful``). The output
    mode of the query decides whether a late row refines a window (update) or windows come once, when the watermark has
    passed them (append); sessions come in append mode only. All keys share the watermark.
    """
    marked = rows.withWatermark(time, f"{lateness} milliseconds")
    ms = F.unix_millis(F.col(time))
    out = []
    for i, added in enumerate(windows):
        w = added.window if isinstance(added, Added) else added
        x, size = marked, F.lit(0)
        if isinstance(w, Session):
            at = F.session_window(time, f"{w.gap} milliseconds")
        elif isinstance(w, FixedBand):
            x = marked.where((F.col(time) >= at_millis(w.start, "timestamp")) & (F.col(time) < at_millis(w.start + w.size, "timestamp")))
            at = F.window(time, f"{w.size} milliseconds", f"{w.size} milliseconds", f"{w.start % w.size} milliseconds")
        elif is_timed(w) and w.slide > w.size:
            x = marked.where(F.pmod(ms, F.lit(w.slide)) < w.size)
            at, size = F.window(time, f"{w.slide} milliseconds"), F.lit(w.slide - w.size)
        elif is_timed(w):
            at = F.window(time, f"{w.size} milliseconds", f"{w.slide} milliseconds")
        else:
            raise TypeError(f"no window over a stream without state of its own: {w!r}")
        # Spark asks for a key of sessions, and one that it does not see to be constant.
        by = list(keys) or ([(F.month(time) * 0).alias("_all")] if isinstance(w, Session) else [])
        x = x.groupBy(*by, at.alias("_w")).agg(*[c.alias(f"_p{k}_{j}") for k, a in enumerate(aggregates) for j, c in enumerate(a.lift)])
        values = [a.lower(*[F.col(f"_p{k}_{j}") for j in range(len(a.lift))]).alias(a.name) for k, a in enumerate(aggregates)]
        start, end = F.unix_millis("_w.start"), F.unix_millis("_w.end") - size
        x = x.select(F.lit(i).alias("spec"), *keys, start.alias("start"), end.alias("end"), *values).where("start >= 0")
        out.append(x.where(F.col("start") >= added.since) if isinstance(added, Added) else x)
    return reduce(DataFrame.unionByName, out)
