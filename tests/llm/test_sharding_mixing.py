import hashlib
import re
import zlib
from collections import Counter

import pytest

from slicewin.llm.mixing import mix
from slicewin.llm.sharding import assign_shards, ring_points, walk_ring

DOCS = "doc_id long, text string, source string, size long, shard int, slot int, ring int"


def odd(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], DOCS)


ROWS = [
    *((i, f"text {i % 37} " * (i % 5), f"s{i % 3}") for i in range(300)),
    *((1000 + i, "the same text in a third of the rows", "s0") for i in range(200)),
    (None, None, None), (5, None, "s1"), (5, None, "s1"), (7, "", None), (8, "x" * 50_000, "s2"), (9, "é ü 𝄞", "ß"),
]


def test_shards_are_full_and_follow_the_ring(spark):
    got = assign_shards(odd(spark, ROWS), 40).collect()
    assert len(got) == len(ROWS)
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(40))
    for s, n in per.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    again = assign_shards(odd(spark, ROWS[::-1]).repartition(3), 40).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_equal_texts_stay_together_unless_a_shard_is_full(spark):
    rows = [(i, f"group {i // 4}", "s") for i in range(800)]
    got = assign_shards(odd(spark, rows), 4).collect()
    split = sum(len({r["shard"] for r in got if r["doc_id"] // 4 == g}) > 1 for g in range(200))
    assert split <= 4


def test_walk_against_rows_one_by_one():
    points = ring_points(5, 4)
    counts = {3: 10, 700: 1, 701: 25, 2000: 2, 4095: 9}
    room, want = [10, 10, 9, 9, 9], []
    for slot in sorted(counts):
        for _ in range(counts[slot]):
            clockwise = [s for p, s in points if p >= slot] + [s for _, s in points]
            shard = next(s for s in clockwise if room[s])
            room[shard] -= 1
            want.append((slot, shard))
    got = [(slot, shard) for slot, ps in walk_ring(counts, points, 5).items() for lo, hi, shard, _ in ps for _ in range(lo, hi)]
    assert got == want


def test_no_rows(spark):
    assert assign_shards(odd(spark, [])).count() == 0
    assert mix(odd(spark, [])).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {s: 0.0 for s in order}, set(order), float(sum(sizes.values()))
    while left > 1e-9 and free:
        w, share, left = sum(weight[s] for s in free), left, 0.0
        for s in list(free):
            target[s] += share * weight[s] / w
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("rows", [ROWS, [(i, "a b", f"s{i}") for i in range(20)], [(1, None, None), (2, "", "x")]])
def test_mix_against_brute_force(spark, rows):
    got = mix(odd(spark, rows)).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    target = brute_targets(sizes)
    taken = Counter()
    for s in sizes:
        docs = sorted(((hashlib.md5(str("null" if i is None else i).encode()).hexdigest(), count(t), i) for i, t, x in rows if x == s), key=lambda d: d[:2])
        budget = int(target[s] + 1e-6)
        left = budget - (budget // sizes[s] * sizes[s] if sizes[s] else 0)
        for _, n, i in docs:
            t = (budget // sizes[s] if sizes[s] else 0) * n + min(n, max(0, left))
            left -= n
            taken[(i, s, n, t)] += 1
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == taken
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
