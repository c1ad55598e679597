"""Runs a configuration: shared slices against one window expression for each window; rows a second."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.bench.configurations import Configuration
from slicewin.functions import aggregates as A
from slicewin.operators.windows import Sliding, Tumbling
from slicewin.plans.planner import aggregate_windows, is_timed
from slicewin.sources.generators import load

#: The aggregates that a configuration can name.
AGGREGATES = {"Sum": lambda: A.sum_of("value"), "Count": lambda: A.count_rows(), "Min": lambda: A.min_of("value"), "Max": lambda: A.max_of("value"), "Mean": lambda: A.mean_of("value"), "Quantile": lambda: A.shared_quantile_of("value", 1, 2)}


@dataclass
class Throughput:
    """Rows a second of several runs."""

    seen: list[float] = field(default_factory=list)

    def add(self, rows: int, seconds: float) -> float:
        self.seen.append(rows / max(seconds, 1e-9))
        return self.seen[-1]

    @property
    def mean(self) -> float:
        return sum(self.seen) / len(self.seen) if self.seen else 0.0

    @staticmethod
    def of_progress(progress: list) -> Throughput:
        """From the progress reports of a streaming query; batches without rows do not count."""
        return Throughput([p["processedRowsPerSecond"] for p in progress if p["numInputRows"]])


def bucketed(rows: DataFrame, windows: list, aggregates: list, keys: list[str]) -> DataFrame:
    """Each window by Spark's own window expression, from all rows; no slices are shared."""
    stamped = rows.withColumn("_at", F.timestamp_millis("ts"))
    out = []
    for i, w in enumerate(windows):
        if not isinstance(w, Tumbling | Sliding) or not is_timed(w) or w.slide > w.size:
            raise TypeError(f"not a window of Spark's own: {w!r}")
        at = F.window("_at", f"{w.size} milliseconds", f"{w.slide} milliseconds")
        x = stamped.groupBy(*keys, at.alias("_w")).agg(*[c.alias(f"_p{k}_{j}") for k, a in enumerate(aggregates) for j, c in enumerate(a.lift)])
        values = [a.lower(*[F.col(f"_p{k}_{j}") for j in range(len(a.lift))]).alias(a.name) for k, a in enumerate(aggregates)]
        out.append(x.select(F.lit(i).alias("spec"), *keys, F.unix_millis("_w.start").alias("start"), F.unix_millis("_w.end").alias("end"), *values).where("start >= 0"))
    return reduce(DataFrame.unionByName, out)


def timed(df: DataFrame) -> float:
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def run(spark: SparkSession, c: Configuration, rows: int | None = None) -> list[dict]:
    """One row for each list of windows, aggregate and plan (Slicing, or Bucket for one expression each)."""
    n = rows or c.throughput * c.runtime
    data = load(spark, n, c.throughput, c.gaps)
    out = []
    for windows in c.windows:
        for name in c.aggregates:
            for plan in c.plans:
                df = aggregate_windows(data, windows, [AGGREGATES[name]()], keys=["key"]) if plan == "Slicing" else bucketed(data, windows, [AGGREGATES[name]()], ["key"])
                seconds = timed(df)
                out.append({"plan": plan, "aggregate": name, "windows": len(windows), "rows": n, "seconds": round(seconds, 3), "rows_per_second": round(n / seconds)})
    return out
