"""Operator 2: consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Rows are placed on a ring of ``2**RING_BITS`` slots by the hash of their text, so that equal texts
stand together. Each shard owns ``vnodes`` points of the ring. A row belongs to the first point
clockwise of it whose shard is not full; rows that overflow a full shard continue clockwise. The
capacities are N/n rounded down or up and add up to N, hence the shards' row counts differ by one at
most (law ``rows``) and only the overflow moves.

The walk needs only the number of rows in each slot. These counts, and those of the parts into which
crowded slots are split, are at most ``2**RING_BITS + 4 * shuffle partitions`` whatever the input, so
the driver walks the ring over counts; which row takes which place follows from its rank in its part,
a window over evenly sized parts. A text that holds a third of all rows makes one crowded slot, which
is split by the hash of the rows' ids.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewin.llm.common import literal_table, materialize, shuffle_partitions, table

RING_BITS = 12
VNODES = 16


def ring_points(n_shards: int, vnodes: int = VNODES, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise; a function of the numbers alone."""

    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.md5(f"shard {shard} node {v}".encode()).digest()[:8], "big") >> (64 - bits)

    return sorted((place(s, v), s) for s in range(n_shards) for v in range(vnodes))


def walk_ring(counts: dict[int, int], points: list[tuple[int, int]], n_shards: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each slot the pieces (from rank, to rank, shard, first place in the shard), in order of ranks.

    Slots are served in ring order. ``counts`` has the rows of each slot.
    """
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    slots = [p for p, _ in points]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for slot in sorted(counts):
        at, rank, left = bisect_left(slots, slot), 0, counts[slot]
        while left:
            shard = points[at % len(points)][1]
            if take := min(left, room[shard]):
                out.setdefault(slot, []).append((rank, rank + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return out


def assign_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16. slot: the row's place in its shard, gapless from 0. A null
    text counts as empty for size and checksum and is a key of its own; null ids, repeated rows and
    ties are rows like others (equal rows may swap places). Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(F.col(text_col))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            h.alias("h"),
            F.shiftrightunsigned(h, 64 - RING_BITS).cast("int").alias("ring"),
            F.xxhash64(F.col(id_col), F.lit(2)).alias("r"),
        ),
        "sharding",
    )
    counts = {r["ring"]: r["n"] for r in rows.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    even = max(1, -(-sum(counts.values()) // (4 * shuffle_partitions(spark))))
    crowded = [(s, -(-n // even)) for s, n in sorted(counts.items()) if n > even]
    split = rows.join(F.broadcast(literal_table(spark, crowded, "ring int, parts int")), "ring", "left")
    split = split.withColumn("part", F.coalesce(F.pmod("r", "parts"), F.lit(0)).cast("int"))
    parts = {(r["ring"], r["part"]): r["n"] for r in split.where("parts is not null").groupBy("ring", "part").agg(F.count(F.lit(1)).alias("n")).collect()} if crowded else {}
    several = {s for s, _ in crowded}
    units: dict[int, list[tuple[int, int]]] = {s: [(0, n)] for s, n in counts.items() if s not in several}
    for (s, p), n in sorted(parts.items()):
        units.setdefault(s, []).append((p, n))
    pieces = []
    for s, taken in walk_ring(counts, ring_points(n_shards, vnodes), n_shards).items():
        begin = 0
        for part, n in units[s]:
            for lo, hi, shard, first in taken:
                a, b = max(lo, begin), min(hi, begin + n)
                if a < b:
                    pieces.append((s, part, b - begin, shard, first + (a - lo) - (a - begin)))
            begin += n
    plan = literal_table(spark, sorted(pieces), "ring int, part int, upto long, shard int, shift long")
    plan = plan.groupBy("ring", "part").agg(F.array_sort(F.collect_list(F.struct("upto", "shard", "shift"))).alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("ring", "part").orderBy("h", "r", "doc_id", "size", "text_crc32")) - 1
    placed = split.withColumn("rank", rank.cast("long")).join(F.broadcast(plan), ["ring", "part"])
    piece = F.filter("pieces", lambda p: p["upto"] > F.col("rank"))[0]
    return placed.withColumn("piece", piece).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("piece.shard").alias("shard"),
        (F.col("piece.shift") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
