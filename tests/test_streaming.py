import os
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from slicewin.functions import aggregates as A
from slicewin.operators import windows as W
from slicewin.plans.planner import aggregate_windows
from slicewin.sources import connectors
from slicewin.streaming.stateful import stream_stateful
from slicewin.streaming.windows import stream_windows, use_rocksdb

SCHEMA = "value long, ts timestamp, key string"


def at(ms):
    return datetime.fromtimestamp(ms / 1000, UTC)


def streamed(spark, tmp_path, batches, build, mode="append"):
    """What a stream gives whose micro-batches hold the events ``value@ms`` of each text."""
    path = tmp_path / uuid.uuid4().hex
    for i, text in enumerate(batches):
        rows = [(int(e.split("@")[0]), at(int(e.split("@")[1])), "k") for e in text.split()]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
        for f in (path / str(i)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = connectors.from_files(spark, f"{path}/*", SCHEMA, files_per_trigger=1)
    name = f"s{uuid.uuid4().hex}"
    query = connectors.to_memory(build(rows), name, mode, str(tmp_path / name))
    query.awaitTermination(180)
    assert query.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def tens_from_first(rows):
    """Windows of 10 that open at the first row not in the one before."""
    out = []
    for t in rows["time"]:
        if not out or t >= out[-1][1]:
            out.append((t, t + 10))
    return out


T1 = ["1@1000 2@19000", "3@29000 4@39000", "5@49000", "0@500000"]


def test_time_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    windows = [W.Tumbling(10_000), W.Sliding(10_000, 5_000), W.Sliding(4_000, 10_000), W.FixedBand(14_000, 11_000), W.Session(10_000)]
    got = streamed(spark, tmp_path, T1, lambda rows: stream_windows(rows, windows, [A.sum_of("value"), A.count_rows()], lateness=0))
    rows = [(int(e.split("@")[0]), int(e.split("@")[1])) for t in T1 for e in t.split()]
    want = aggregate_windows(spark.createDataFrame(rows, "value long, ts long"), windows, [A.sum_of("value"), A.count_rows()], watermark=500_000)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_late_rows_refine_windows_in_update_mode(spark, tmp_path):
    got = streamed(spark, tmp_path, ["1@2600 1@2800", "1@2605 1@3010", "1@1500"], lambda rows: stream_windows(rows, [W.Tumbling(10)], [A.sum_of("value")], lateness=1_000), "update")
    assert [r[1:] for r in got if r[1] == 2600] == [(2600, 2610, 1), (2600, 2610, 2)]
    assert not [r for r in got if r[1] == 1500]


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_punctuations_of_a_stream(spark, tmp_path, keys):
    use_rocksdb(spark)
    batches = ["1@1 0@10 2@19", "2@20 3@23 4@32 1@34 1@40 0@30", "5@49 0@51", "0@500"]
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.Punctuation(F.col("value") == 0), [("value", A.fold_sum())], keys=keys, lateness=20))
    assert sorted(r[len(keys) :] for r in got) == [(1, 10, 1), (10, 30, 7), (30, 51, 11)]


def test_counts_of_a_stream(spark, tmp_path):
    use_rocksdb(spark)
    batches = ["1@1 1@19 1@29", "2@39 2@10", "2@50 1@51", "9@1000"]
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.CountTumbling(3), [("value", A.fold_sum()), ("value", A.fold_mean())], keys=["key"], lateness=30))
    assert got == [("k", 0, 3, 4, 4 / 3), ("k", 3, 6, 5, 5 / 3)]
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.CountSliding(3, 2), [("value", A.fold_max()), ("value", A.fold_count())], keys=["key"], lateness=30))
    assert got == [("k", 0, 3, 2, 3), ("k", 2, 5, 2, 3), ("k", 4, 7, 2, 3)]


@pytest.mark.parametrize("batches, want", [(["1@1 2@2 3@3 4@4"], [(0, 2, 3)]), (["1@1 2@2 3@3 4@4", "5@10"], [(0, 2, 3), (2, 4, 7)])])
def test_counts_of_a_stream_are_of_rows_before_the_watermark(spark, tmp_path, batches, want):
    """The newest row waits until the watermark has passed it, and does not hold up those before it."""
    use_rocksdb(spark)
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.CountTumbling(2), [("value", A.fold_sum())], keys=["key"], lateness=0))
    assert got == [("k", *w) for w in want]


def test_late_sessions_are_refined(spark, tmp_path):
    use_rocksdb(spark)
    batches = ["1@2600 1@2610 1@2800", "1@3000", "1@2605 1@3010", "7@2621", "9@9000"]
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.Session(10), [("value", A.fold_sum())], keys=["key"], lateness=1_000), "update")
    assert [r for r in got if r[1] == 2600] == [("k", 2600, 2620, 2), ("k", 2600, 2620, 3)]
    assert ("k", 2621, 2631, 7) in got and ("k", 2800, 2810, 1) in got and ("k", 3000, 3020, 2) in got


def test_merged_sessions_are_taken_back(spark, tmp_path):
    use_rocksdb(spark)
    batches = ["1@2600 1@2615", "1@3000", "1@3100", "1@2608", "9@9000"]
    got = streamed(spark, tmp_path, batches, lambda rows: stream_stateful(rows, W.Session(10), [("value", A.fold_sum())], keys=["key"], lateness=1_000), "update")
    assert [r for r in got if r[1] < 2700] == [("k", 2600, 2610, 1), ("k", 2615, 2625, 1), ("k", 2615, 2625, None), ("k", 2600, 2625, 3)]


def test_windows_of_a_users_context(spark, tmp_path):
    use_rocksdb(spark)

    got = streamed(spark, tmp_path, ["1@1 2@5", "4@9 8@20", "16@35", "0@100"], lambda rows: stream_stateful(rows, W.UserContext(tens_from_first), [("value", A.fold_sum())], keys=["key"], lateness=0))
    assert got == [("k", 1, 11, 7), ("k", 20, 30, 8), ("k", 35, 45, 16)]


def test_only_windows_with_state_of_their_own_are_stateful(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(TypeError):
        stream_stateful(rows, W.Tumbling(5), [])
    with pytest.raises(TypeError):
        stream_windows(rows, [W.CountTumbling(3)], [])
