"""Operator 4: exact top-k search by Fagin's threshold algorithm.

Vectors are held in blocks. A block has a list for each dimension, sorted by that component. Each query walks
its own lists, each from the end that the query's component favours, in steps of growing depth, scores every vector that it
meets for the first time, and stops where the bound cannot beat its k-th best score: the bound at a depth is the
score of a vector with the components that the lists have there, which no vector not yet met exceeds. The k best
are kept from block to block, so that later blocks stop sooner.

Queries go to the tasks in blocks of at most QUERY_BYTES, one turn over the vectors for each, whose result is written
before the next; each task gives k rows for each query, of which the k best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewin.llm.common import materialize, table

ROWS, QUERY_BYTES, FIRST = 1 << 14, 32 << 20, 8


class Best:
    """The k best of each query so far; ties go to the smaller id. ``scored`` counts the vectors that a query met."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(q), k), -np.inf)
        self.vec = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scored = np.zeros(len(q), np.int64)

    def add(self, a: int, scores: np.ndarray, vec: np.ndarray) -> None:
        hit = np.flatnonzero((scores >= self.score[a, -1]) & (vec != self.ids[a]))
        if not len(hit):
            return
        if len(hit) > 4 * self.k:
            s = scores[hit]
            hit = hit[s >= np.partition(s, -self.k)[-self.k]]
        s, v = np.concatenate([self.score[a], scores[hit]]), np.concatenate([self.vec[a], vec[hit]])
        o = np.lexsort((v, -s))[: self.k]
        self.score[a], self.vec[a] = s[o], v[o]

    def search(self, vec: np.ndarray, v: np.ndarray) -> None:
        """Each query's walk over the lists of one block."""
        m = len(v)
        order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
        lists = np.take_along_axis(v.T, order, axis=1)
        for a in range(len(self.q)):
            q = self.q[a]
            up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
            met, before, depth = np.zeros(m, bool), 0, min(FIRST, m)
            if not len(up) and not len(down):
                # A query of zeros scores all alike; no list says more.
                self.add(a, np.zeros(m), vec)
                self.scored[a] += m
                continue
            while True:
                fresh = np.zeros(m, bool)
                fresh[order[up, m - depth : m - before]] = True
                fresh[order[down, before:depth]] = True
                now = np.flatnonzero(fresh & ~met)
                met[now] = True
                self.scored[a] += len(now)
                self.add(a, v[now] @ q, vec[now])
                if depth == m or met.all():
                    break
                bound = q[up] @ lists[up, m - depth] + q[down] @ lists[down, depth - 1]
                if bound < self.score[a, -1]:
                    break
                before, depth = depth, min(m, 2 * depth)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.transform(vec_col, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("double"))
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, scored: the k best of all other vectors for each id divisible by ``every``.

    scored is the number of vectors that the query's walks met, of all candidates.

    Vectors without id, null, or with null or non-finite components take no part; a query is compared
    with vectors of its own length. Rows of one id as candidates count as often as they are there; a
    query id that occurs repeatedly is searched once, with its smallest vector. Sums are exact up to
    2**53. Fewer than k rows come only where there are fewer candidates. Other columns are not read; an empty table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col)
    queries = materialize(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = queries.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    turns = max(1, -(-size // QUERY_BYTES))
    out = None
    for turn in range(turns):
        part = queries if turns == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn)
        block: dict[int, tuple[list, list]] = {}
        for r in part.sort("vec_id").collect():
            ids, q = block.setdefault(len(r["v"]), ([], []))
            ids.append(r["vec_id"])
            q.append(r["v"])
        packed = {d: (np.array(i), np.array(q, np.float64).reshape(len(q), d)) for d, (i, q) in block.items()}

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            best = {d: Best(i, q, k) for d, (i, q) in packed.items()}
            held: dict[int, list] = {d: [] for d in best}

            def flush(d: int) -> None:
                if held[d]:
                    best[d].search(np.concatenate([h[0] for h in held[d]]), np.concatenate([h[1] for h in held[d]]))
                    held[d] = []

            for b in batches:
                ids, lengths = b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                flat, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
                for d in set(lengths.tolist()) & set(best):
                    pick = np.flatnonzero(lengths == d)
                    held[d].append((ids[pick], flat[(ends[pick] - d)[:, None] + np.arange(d)]))
                    if sum(len(h[0]) for h in held[d]) >= ROWS:
                        flush(d)
            for d, x in best.items():
                flush(d)
                i, j = np.nonzero(x.score > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.ids[i]), pa.array(x.vec[i, j]), pa.array(x.score[i, j].astype(np.int64)), pa.array(np.where(j == 0, x.scored[i], 0))], names=["query_id", "vec_id", "score", "scored"]
                )

        whole = Window.partitionBy("query_id")
        found = rows.mapInArrow(run, "query_id long, vec_id long, score long, scored long").withColumn("scored", F.sum("scored").over(whole))
        found = found.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
        found = found.select("query_id", "rank", "vec_id", "score", "scored")
        found = found if turns == 1 else materialize(found, "turn")
        out = found if out is None else out.unionByName(found)
    return out


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings")).drop("scored")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
