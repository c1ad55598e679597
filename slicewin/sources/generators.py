"""Rows to feed the engine with: demo counters, load with session gaps, and disorder, all from expressions on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class JavaRandom:
    """The numbers that java.util.Random gives for a seed, by its published rule, so that drawn windows are the same."""

    #: Fixed values of the published generator.
    FACTOR, ADD, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1

    def __init__(self, seed: int):
        self.state = (seed ^ self.FACTOR) & self.MASK

    def bits(self, n: int) -> int:
        self.state = (self.state * self.FACTOR + self.ADD) & self.MASK
        return self.state >> (48 - n)

    def below(self, bound: int) -> int:
        if bound <= 0:
            raise ValueError("the bound is positive")
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            x = self.bits(31)
            if x - x % bound + bound - 1 < 1 << 31:
                return x % bound

    def share(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)


def session_gaps(count: int, until: int, shortest: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of gaps without rows, in order of start; fixed seeds 333 for starts and 777 for lengths."""
    starts, lengths = JavaRandom(333), JavaRandom(777)
    return sorted(((starts.below(until), shortest + lengths.below(longest - shortest)) for _ in range(count)), key=lambda g: g[0])


def counters(spark: SparkSession, rows: int, keys: int = 1) -> DataFrame:
    """key, value 1, 2, 3 ... and ts 0, 1, 2 ..."""
    return spark.range(rows).select((F.col("id") % keys).cast("int").alias("key"), (F.col("id") + 1).cast("int").alias("value"), F.col("id").alias("ts"))


def load(spark: SparkSession, rows: int, per_second: int, gaps: list[tuple[int, int]] = (), keys: int = 1, seed: int = 7) -> DataFrame:
    """key, value in 0 to 9 and ts in milliseconds at ``per_second`` rows a second, none within ``gaps`` (start, length)."""
    ts = F.floor(F.col("id") * 1000 / per_second).cast("long")
    # A gap pushes back all that would come at its start or later.
    for start, length in sorted(gaps):
        ts = F.when(ts >= start, ts + length).otherwise(ts)
    value = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10)).cast("int")
    return spark.range(rows).select((F.col("id") % keys).cast("int").alias("key"), value.alias("value"), ts.alias("ts"))


@dataclass(frozen=True)
class Disorder:
    """``percent`` of the rows come later than their time says, by at least ``least`` and at most ``most``."""

    percent: int
    least: int
    most: int
    seed: int = 11

    def of(self, rows: DataFrame, time: str = "ts", by: str = "ts", arrival: str = "arrival") -> DataFrame:
        """``rows`` with the time of their arrival; which rows are late follows from ``by`` and the seed."""
        draw = F.pmod(F.xxhash64(by, F.lit(self.seed)), F.lit(100))
        delay = F.pmod(F.xxhash64(by, F.lit(self.seed + 1)), F.lit(self.most - self.least + 1)) + self.least
        return rows.withColumn(arrival, F.when(draw < self.percent, F.col(time) + delay).otherwise(F.col(time)))


def rate(spark: SparkSession, per_second: int = 1000, keys: int = 1, seed: int = 7) -> DataFrame:
    """A stream of key, value in 0 to 9 and ts (timestamp)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select((F.col("value") % keys).cast("int").alias("key"), F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(10)).cast("int").alias("value"), F.col("timestamp").alias("ts"))


def rate_batches(spark: SparkSession, rows_per_batch: int = 1000, start_ms: int = 0, advance_ms: int = 1000, keys: int = 1) -> DataFrame:
    """As ``rate`` with a fixed number of rows and of milliseconds for each micro-batch, so that runs agree."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("startTimestamp", start_ms).option("advanceMillisPerBatch", advance_ms).load()
    return ticks.select((F.col("value") % keys).cast("int").alias("key"), F.pmod(F.xxhash64("value"), F.lit(10)).cast("int").alias("value"), F.col("timestamp").alias("ts"))
