"""Which rows of a recorded stream came too late, for batches that replay one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewin.plans.planner import ROWS, T


def drop_late(arrival: str, lateness: int) -> Callable[[DataFrame], DataFrame]:
    """Rows whose time is at least the largest time that arrived before them, less ``lateness``.

    ``arrival`` is a whole number; rows that arrive together see the same rows before them. The largest time is found
    within stretches of arrivals first and carried over by one row a stretch. For ``aggregate_windows(late=)``.
    """

    def kept(rows: DataFrame) -> DataFrame:
        low, high, n = rows.agg(F.min(arrival), F.max(arrival), F.count(F.lit(1))).first()
        width = max(1, (high - low + 1) * ROWS // n) if n else 1
        x = rows.withColumn("_came", F.floor(F.col(arrival) / width).cast("long"))
        per = x.groupBy("_came").agg(F.max(T).alias("_high"))
        before = Window.orderBy("_came").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(F.col("_came").alias("_c"), F.max("_high").over(before).alias("_carry"))
        within = Window.partitionBy("_came").orderBy(arrival).rangeBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("_seen", F.max(T).over(within)).join(per, F.col("_came") == F.col("_c"))
        seen = F.greatest("_seen", "_carry")
        return x.where(seen.isNull() | (F.col(T) >= seen - lateness)).drop("_came", "_c", "_carry", "_seen")

    return kept
