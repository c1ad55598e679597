import pytest
from pyspark.sql import functions as F

from slicewin.functions import aggregates as A
from slicewin.operators import windows as W
from slicewin.plans.planner import aggregate_windows


def found(spark, text, windows, aggregates=None, **more):
    rows = [tuple(int(x) for x in e.split("@")) for e in text.split()]
    df = spark.createDataFrame(rows, "value long, ts long") if rows else spark.createDataFrame([], "value long, ts long")
    out = aggregate_windows(df, windows, aggregates or [A.sum_of("value")], **more)
    return sorted(tuple(r) for r in out.collect())


T = "1@1 2@19 3@29 4@39 5@49"
CASES = [
    (T, [W.Tumbling(10)], [(0, 0, 10, 1), (0, 10, 20, 2), (0, 20, 30, 3), (0, 30, 40, 4), (0, 40, 50, 5)]),
    ("1@1 1@19 1@29 2@39 2@49 2@50 1@51", [W.CountTumbling(3)], [(0, 0, 3, 3), (0, 3, 6, 6)]),
    ("1@1 1@19 1@29 2@39 2@10 2@50 1@51", [W.CountTumbling(3)], [(0, 0, 3, 4), (0, 3, 6, 5)]),
    ("1@1 1@10 1@11 1@12 1@13 1@14 1@15 3@19 4@29 5@36", [W.Sliding(10, 4)], [(0, 0, 10, 1), (0, 4, 14, 4), (0, 8, 18, 6), (0, 12, 22, 7), (0, 16, 26, 3), (0, 20, 30, 4), (0, 24, 34, 4), (0, 28, 38, 9), (0, 32, 42, 5), (0, 36, 46, 5)]),
    ("1@1 2@19 3@23 4@31 5@49", [W.Session(10)], [(0, 1, 11, 1), (0, 19, 41, 9), (0, 49, 59, 5)]),
    ("1@7 1@30 1@51 1@15 1@21", [W.Session(10)], [(0, 7, 40, 4), (0, 51, 61, 1)]),
    (T, [W.FixedBand(1, 10)], [(0, 1, 11, 1)]),
    ("", [W.Tumbling(10), W.Session(5), W.CountSliding(3, 1)], []),
]


@pytest.mark.parametrize("text, windows, expected", CASES)
def test_windows(spark, text, windows, expected):
    assert found(spark, text, windows) == expected


def test_sessions_of_two_gaps(spark):
    out = found(spark, "1@20 1@40 1@50 1@57 1@33 1@31", [W.Session(10), W.Session(5)])
    assert [r for r in out if r[0] == 0] == [(0, 20, 30, 1), (0, 31, 67, 5)]
    assert [r for r in out if r[0] == 1] == [(1, 20, 25, 1), (1, 31, 38, 2), (1, 40, 45, 1), (1, 50, 55, 1), (1, 57, 62, 1)]


def test_punctuation_closes_windows(spark):
    out = found(spark, "1@1 0@5 2@7 0@9 3@12", [W.Punctuation(F.col("value") == 0)], [A.sum_of("value"), A.count_rows()])
    assert out == [(0, 1, 5, 1, 1), (0, 5, 9, 2, 2)]


def test_aggregates(spark):
    out = found(spark, "-7@1 2@2 2@3 9@4", [W.Tumbling(10)], [A.mean_of("value"), A.integer_mean_of("value", "i"), A.quantile_of("value", 0.5), A.reduce_of("value", "ts", lambda a, b: a - b)])
    assert out == [(0, 0, 10, 1.5, 1, 2, -20)]


def test_user_defined_windows_and_watermark(spark):
    w = W.UserDefined(lambda t: F.array(F.struct((t - t % 7).alias("start"), (t - t % 7 + 7).alias("end"))))
    assert found(spark, "1@1 2@8 3@15", [w], watermark=14) == [(0, 0, 7, 1), (0, 7, 14, 2)]


def test_sizes_are_positive():
    with pytest.raises(ValueError):
        W.Tumbling(0)
