"""Windows that a window engine of these semantics gives for small streams, up to a watermark.

Events are ``value@time``, windows ``start-end=sum``; rows are given in reverse, as their order of arrival does not count.
"""

import pytest
from pyspark.sql import functions as F

from slicewin.functions import aggregates as A
from slicewin.operators import windows as W
from slicewin.plans.planner import aggregate_windows
from slicewin.streaming.lateness import drop_late

ONE = "1@1 2@19 3@29 4@39 5@49"
TWO = "1@0 2@0 3@20 4@30 5@40"
SIX = "1@1 1@30 1@20 1@23 1@25 1@45"
COUNTS = "1@1 1@19 1@29 2@39 1@41 2@10 2@50 1@51 3@52"
CASES = {
    "T1": ([W.Tumbling(10)], ONE, {22: ["0-10=1 10-20=2"], 55: ["0-10=1 10-20=2 20-30=3 30-40=4 40-50=5"]}),
    "T2": ([W.Tumbling(10)], TWO, {22: ["0-10=3"], 55: ["0-10=3 20-30=3 30-40=4 40-50=5"]}),
    "T3": ([W.Tumbling(10), W.Tumbling(20)], ONE, {22: ["0-10=1 10-20=2", "0-20=3"], 55: ["0-10=1 10-20=2 20-30=3 30-40=4 40-50=5", "0-20=3 20-40=7"]}),
    "T4": ([W.Tumbling(10), W.Added(W.Tumbling(20), 0)], ONE, {55: ["0-10=1 10-20=2 20-30=3 30-40=4 40-50=5", "0-20=3 20-40=7"]}),
    "T5": ([W.Tumbling(20), W.Added(W.Tumbling(10), 20)], ONE, {22: ["0-20=3", ""], 55: ["0-20=3 20-40=7", "20-30=3 30-40=4 40-50=5"]}),
    "T6": ([W.Tumbling(10)], SIX, {22: ["0-10=1"], 55: ["0-10=1 20-30=3 30-40=1 40-50=1"]}),
    "N1": ([W.CountTumbling(3)], "1@1 1@19 1@29 2@39 2@49 2@50 1@51", {55: ["0-3=3 3-6=6"]}),
    "N2": ([W.CountTumbling(3)], "1@1 1@19 1@29 2@39 2@10 2@50 1@51", {55: ["0-3=4 3-6=5"]}),
    "N3": ([W.CountTumbling(3), W.CountTumbling(5)], COUNTS, {55: ["0-3=4 3-6=4 6-9=6", "0-5=7"]}),
    "N4": ([W.CountTumbling(3), W.CountTumbling(5)], "1@1 1@19 1@29 2@39 1@41 2@10", {30: ["0-3=4", ""]}),
    "S1": ([W.Sliding(10, 5)], ONE, {22: ["0-10=1 10-20=2"], 55: ["0-10=1 10-20=2 15-25=2 20-30=3 25-35=3 30-40=4 35-45=4 40-50=5 45-55=5"]}),
    "S2": ([W.Sliding(10, 5)], TWO, {22: ["0-10=3"], 55: ["0-10=3 15-25=3 20-30=3 25-35=4 30-40=4 35-45=5 40-50=5"]}),
    "S3": ([W.Sliding(10, 5), W.Tumbling(20)], ONE, {22: ["0-10=1 10-20=2", "0-20=3"]}),
    "S4": (
        [W.Sliding(10, 3)],
        "1@1 1@9 1@10 1@11 1@12 1@13 1@14 1@15 1@19 2@21 1@22 1@23 1@24 3@29 4@36",
        {22: ["0-10=2 3-13=4 6-16=7 9-19=7 12-22=7"], 37: ["0-10=2 3-13=4 6-16=7 9-19=7 12-22=7 15-25=7 18-28=6 21-31=8 24-34=4 27-37=7"]},
    ),
    "S5": ([W.Sliding(10, 4)], "1@1 1@10 1@11 1@12 1@13 1@14 1@15 3@19 4@29 5@36", {22: ["0-10=1 4-14=4 8-18=6 12-22=7"], 42: ["0-10=1 4-14=4 8-18=6 12-22=7 16-26=3 20-30=4 24-34=4 28-38=9 32-42=5"]}),
    "S6": ([W.Sliding(10, 5)], SIX, {22: ["0-10=1"], 55: ["0-10=1 15-25=2 20-30=3 25-35=2 30-40=1 40-50=1 45-55=1"]}),
    "E1": ([W.Session(10)], "1@1 2@19 3@23 4@31 5@49", {22: ["1-11=1"], 55: ["1-11=1 19-41=9"], 59: ["1-11=1 19-41=9"], 80: ["1-11=1 19-41=9 49-59=5"]}),
    "E2": ([W.Session(10)], "1@0 2@0 3@20 4@31 5@42", {22: ["0-10=3"], 55: ["0-10=3 20-30=3 31-41=4 42-52=5"]}),
    "E3": ([W.Session(10)], "1@1 1@9 1@15 1@30 1@12", {50: ["1-25=4 30-40=1"]}),
    "E4": ([W.Session(10)], "1@1 1@9 1@10 1@30 1@12", {50: ["1-22=4 30-40=1"]}),
    "E5": ([W.Session(10)], "1@1 1@9 1@10 1@30 1@27", {22: ["1-20=3"], 50: ["1-20=3 27-40=2"]}),
    "E6": ([W.Session(10)], "1@1 1@30 1@12", {22: ["1-11=1"], 50: ["1-11=1 12-22=1 30-40=1"]}),
    "E7": ([W.Session(10)], "1@7 1@30 1@51 1@15 1@21", {70: ["7-40=4 51-61=1"]}),
    "E8": ([W.Session(10), W.Tumbling(40)], "1@7 1@22 1@51 1@15 1@37", {70: ["7-32=3 37-47=1 51-61=1", "0-40=4"]}),
    "E9": ([W.Session(10), W.Session(5)], "1@20 1@40 1@50 1@57 1@33 1@31", {70: ["20-30=1 31-67=5", "20-25=1 31-38=2 40-45=1 50-55=1 57-62=1"]}),
    "E10": ([W.Session(10)], "1@2600 1@3700 1@2500", {4000: ["2500-2510=1 2600-2610=1 3700-3710=1"]}),
    "B1": ([W.FixedBand(1, 10)], ONE, {55: ["1-11=1"]}),
    "B2": ([W.FixedBand(0, 10)], TWO, {22: ["0-10=3"], 55: ["0-10=3"]}),
    "B3": ([W.FixedBand(18, 10)], TWO, {22: [""], 55: ["18-28=3"]}),
    "B4": ([W.FixedBand(10, 10), W.FixedBand(20, 10)], ONE, {22: ["10-20=2", ""], 55: ["10-20=2", "20-30=3"]}),
    "B5": ([W.FixedBand(14, 11), W.FixedBand(23, 10)], ONE, {26: ["14-25=2", ""], 55: ["14-25=2", "23-33=3"]}),
    "B6": ([W.FixedBand(10, 10), W.Added(W.FixedBand(20, 21), 20)], ONE, {22: ["10-20=2", ""], 55: ["10-20=2", "20-41=7"]}),
    "B7": ([W.FixedBand(10, 20)], "1@1 1@29 1@20 1@23 1@25 1@45", {22: [""], 55: ["10-30=4"]}),
    "P1": (None, "1@1 0@10 1@10 2@19 3@23 0@30 4@30 5@49 0@51 6@54", {31: ["1-10=1 10-30=6"], 55: ["1-10=1 10-30=6 30-51=9"]}),
    "P2": (None, "0@10 1@10 2@19 3@23 0@30 4@30 5@49 0@51", {31: ["10-30=6"], 51: ["10-30=6 30-51=9"]}),
    "P3": (None, "1@1 0@10 1@10 1@19 1@21 1@23 1@24 1@25 0@30 5@49 5@45 0@51", {55: ["1-10=1 10-30=6 30-51=10"]}),
    "P4": (None, "1@1 0@10 2@19 2@21 2@23 2@24 0@30 5@49 2@5 0@51", {55: ["1-10=3 10-30=8 30-51=5"]}),
    "P5": (None, "1@1 0@10 2@19 0@30 3@21 3@23 3@24 5@49 0@51", {31: ["1-10=1 10-30=11"], 55: ["1-10=1 10-30=11 30-51=5"]}),
    "P6": (None, "1@1 0@10 2@19 2@20 3@23 4@32 1@34 1@40 0@30 5@49 0@51", {31: ["1-10=1 10-30=7"], 55: ["1-10=1 10-30=7 30-51=11"]}),
    "P7": (None, "1@1 0@10 2@19 2@21 2@23 0@30 1@32 1@34 1@40 0@51 1@55 0@20", {56: ["1-10=1 10-20=2 20-30=4 30-51=3"]}),
    "L1": ([W.Tumbling(10)], "1@2000 1@2600 1@2605 1@2800 1@2400 1@3700 2@3800 3@4000", {3000: ["2000-2010=1 2400-2410=1 2600-2610=2 2800-2810=1"], 3900: ["2000-2010=1 2400-2410=1 2600-2610=2 2800-2810=1 3700-3710=1 3800-3810=2"]}),
    "L2": ([W.Tumbling(10)], "1@2600 1@2800 1@2605 1@3010", {3100: ["2600-2610=2 2800-2810=1 3010-3020=1"]}),
    "L3": ([W.Session(10)], "1@2600 1@2800 1@2500 1@3010", {3100: ["2500-2510=1 2600-2610=1 2800-2810=1 3010-3020=1"]}),
    "L4": ([W.Session(10)], "1@2600 1@2610 1@2800 1@2605 1@3010", {3100: ["2600-2620=3 2800-2810=1 3010-3020=1"]}),
}


def windows_of(texts):
    out = []
    for spec, text in enumerate(texts):
        for w in text.split():
            bounds, value = w.split("=")
            out.append((spec, *map(int, bounds.split("-")), int(value)))
    return sorted(out)


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    windows, events, expected = CASES[name]
    windows = windows or [W.Punctuation(F.col("value") == 0)]
    rows = [tuple(int(x) for x in e.split("@")) for e in reversed(events.split())]
    df = spark.createDataFrame(rows, "value long, ts long")
    for watermark, texts in expected.items():
        out = aggregate_windows(df, windows, [A.sum_of("value")], watermark=watermark)
        assert sorted(map(tuple, out.collect())) == windows_of(texts), watermark


#: Rows of two fields: windows close at rows that match a pattern of both.
TUPLES = {
    "P8": ([{"key": "key", "n": None}], "1,1@1 key,0@10 1,2@19 1,3@23 key,0@30 1,4@30 1,5@49 key,0@51", {31: ["1-10=1 10-30=5"], 55: ["1-10=1 10-30=5 30-51=9"]}),
    "P9": ([{"key": ".*", "n": 0}], "1,1@1 123,0@10 1,2@19 1,3@23 234,0@30 1,4@30 1,5@49 345,0@51", {31: ["1-10=1 10-30=5"], 55: ["1-10=1 10-30=5 30-51=9"]}),
    "P10": ([{"key": "1", "n": 0}], "1,1@1 1,0@10 1,2@19 1,0@30 1,3@23 1,5@49 1,0@51", {31: ["1-10=1 10-30=5"], 55: ["1-10=1 10-30=5 30-51=5"]}),
    "P11": ([{"key": "1", "n": 0}, {"key": "123", "n": 0}], "1,1@1 1,0@10 1,2@19 123,0@30 1,3@23 1,5@49 1,0@51 123,0@51", {55: ["1-10=1 10-51=10", "1-30=6 30-51=5"]}),
}


@pytest.mark.parametrize("name", TUPLES)
def test_golden_patterns(spark, name):
    marks, events, expected = TUPLES[name]
    rows = [(e.split(",")[0], *map(int, e.split(",")[1].split("@"))) for e in reversed(events.split())]
    df = spark.createDataFrame(rows, "key string, n long, ts long")
    for watermark, texts in expected.items():
        out = aggregate_windows(df, [W.Punctuation(W.pattern(**m)) for m in marks], [A.sum_of("n")], watermark=watermark)
        assert sorted(map(tuple, out.collect())) == windows_of(texts)


@pytest.mark.parametrize("window, events, expected", [(W.Sliding(10, 5), "1@2600 1@3700 1@1980", {(2600, 2610, 1), (2595, 2605, 1), (3700, 3710, 1), (3695, 3705, 1)}), (W.Session(10), "1@2600 1@2700 1@1500", {(2600, 2610, 1), (2700, 2710, 1)})])
def test_rows_that_are_too_late_are_dropped(spark, window, events, expected):
    rows = [(int(e.split("@")[0]), int(e.split("@")[1]), i) for i, e in enumerate(events.split())]
    df = spark.createDataFrame(rows, "value long, ts long, arrival long")
    out = aggregate_windows(df, [window], [A.sum_of("value")], late=drop_late("arrival", 1000))
    assert {tuple(r)[1:] for r in out.collect()} == expected


def test_empty_windows_are_added(spark):
    rows = [tuple(int(x) for x in e.split("@")) for e in SIX.split()]
    df = spark.createDataFrame(rows, "value long, ts long")
    out = aggregate_windows(df, [W.Tumbling(10), W.Sliding(4, 10)], [A.sum_of("value"), A.count_rows()], include_empty=True, watermark=45)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 10, 1, 1), (0, 10, 20, None, 0), (0, 20, 30, 3, 3), (0, 30, 40, 1, 1), (1, 0, 4, 1, 1), (1, 10, 14, None, 0), (1, 20, 24, 2, 2), (1, 30, 34, 1, 1), (1, 40, 44, None, 0)]
