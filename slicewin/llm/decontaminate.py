r"""Operator 8: benchmark decontamination by winnowing.

Of every WINDOW consecutive k-gram hashes the smallest is kept, in the documents and in the benchmark.
With k + WINDOW - 1 = 10 words, any span of 10 words that a document shares with an item holds a kept
k-gram of both, so the join of kept hashes finds every shared span. Each hit is then compared word by
word and extended to both sides; runs of 10 words and more are hit.

The documents are read once and not shuffled. The benchmark's index goes to the tasks in blocks of at
most BLOCK_BYTES of text, a size that is measured beforehand; a larger benchmark takes one more turn
over the documents for each further block, with the hits so far carried in the rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.llm.common import materialize, table, unfolded, whole_row
from slicewin.llm.textscan import ALNUM, Words, grams, stretches

SPAN, GRAM = 10, 6
WINDOW = SPAN - GRAM + 1
BLOCK_BYTES = 16 << 20
#: Blocks whose turns follow one another without a table written in between.
TURNS = 4

U = np.uint64
LAST = U(2**64 - 1)


def kept(g: np.ndarray) -> np.ndarray:
    """Which hashes are the smallest of a window of WINDOW; of equal ones all."""
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.ones(len(g), bool)
    least = g[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, g[j : j + n], out=least)
    out = np.zeros(len(g), bool)
    for j in range(WINDOW):
        out[j : j + n] |= g[j : j + n] == least
    return out


class Index:
    """Kept k-grams of the long items and whole short items, found by hash."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [n for n, _ in items]
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.words: list[list[bytes]] = []
        long, short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for i0, data, offsets in stretches(texts):
            w = Words(data, offsets, ALNUM)
            for k in range(len(offsets) - 1):
                a, b, item = w.first[k], w.first[k + 1], i0 + k
                self.words.append([w.word(i) for i in range(a, b)])
                if b - a >= SPAN:
                    g = grams(w.hashes[a:b], GRAM)
                    for q in np.flatnonzero(kept(g)).tolist():
                        long[int(g[q])].append((item, q))
                elif b > a:
                    short[int(b - a)][int(grams(w.hashes[a:b], int(b - a))[0])].append((item, 0))
        self.tables = [(n, *self.sieve(t), t) for n, t in [(GRAM, long), *short.items()] if t]
        self.long = bool(long)

    @staticmethod
    def sieve(found: dict) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(found), U)
        bits = np.zeros(1 << 20, bool)
        bits[keys & U(len(bits) - 1)] = True
        return keys, bits

    def search(self, w: Words) -> dict[int, tuple[set[int], set[int]]]:
        """For texts with hits, by index: hit words (from the text's first) and items."""
        out: dict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
        text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        for n, keys, bits, found in self.tables:
            if len(w.hashes) < n:
                continue
            whole = not (n == GRAM and found is self.tables[0][3] and self.long)
            g = grams(w.hashes, n)
            inside = text_of[: len(g)] == text_of[n - 1 :]
            if whole:
                look = inside
            else:
                g[~inside] = LAST
                look = kept(g) & inside
            at = np.flatnonzero(look & bits[g & U(len(bits) - 1)])
            place = np.searchsorted(keys, g[at])
            place[place == len(keys)] = 0
            done: dict[tuple[int, int, int], int] = {}
            for p in at[keys[place] == g[at]].tolist():
                t = int(text_of[p])
                for item, q in found[int(g[p])]:
                    words = self.words[item]
                    if done.get((t, item, q - p), -1) >= p:
                        continue
                    if any(w.word(p + j) != words[q + j] for j in range(n)):
                        continue
                    lo, hi, first, last = p, p + n, int(w.first[t]), int(w.first[t + 1])
                    while not whole and lo > first and q - (p - lo) > 0 and w.word(lo - 1) == words[q - (p - lo) - 1]:
                        lo -= 1
                    while not whole and hi < last and q + hi - p < len(words) and w.word(hi) == words[q + hi - p]:
                        hi += 1
                    done[(t, item, q - p)] = hi - n
                    if whole or hi - lo >= SPAN:
                        out[t][0].update(range(lo - first, hi - first))
                        out[t][1].add(item)
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of about ``block_bytes`` or one item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [tuple(r) for r in part.sort("i", "t").collect()]


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated of each document, with its id or (keep) its columns as struct ``row``.

    Null and wordless texts have no words and are clean; so are all documents if there are no items.
    Items without words are nowhere found. Items with equal ids count once; a null item_id counts as
    ``null``. Repeated documents are judged alike; very long texts are scanned whole. Other columns are not read, or
    stay as they are in ``row``, whatever their names. An empty table gives no rows.
    """
    own = ["row"] if keep else [id_col]
    cols = [whole_row(docs).alias("row")] if keep else [F.col(id_col)]
    rows = docs.select(*cols, F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("_hits"), F.array().cast("array<string>").alias("_found"))
    schema, k = rows.schema, len(own)

    def turn(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = np.zeros(b.num_rows, np.int64)
                hits, found = b.column(k + 2).to_pylist(), b.column(k + 3).to_pylist()
                for i0, data, offsets in stretches(b.column(k)):
                    w = Words(data, offsets, ALNUM)
                    counts[i0 : i0 + len(offsets) - 1] = np.diff(w.first)
                    for t, (words, which) in index.search(w).items():
                        hits[i0 + t] = sorted(set(hits[i0 + t]) | words)
                        found[i0 + t] = sorted(set(found[i0 + t]) | {index.names[x] for x in which})
                new = [pa.array(counts), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], *new], names=schema.names)

        return run

    for n, block in enumerate(blocks_of(items, item_col, text_col, block_bytes)):
        if n and n % TURNS == 0:
            rows = materialize(rows, "overlaps")
        rows = rows.mapInArrow(turn(Index(block)), schema)
    hit = F.size("_hits").cast("long")
    return rows.select(
        *[F.col(c) for c in own],
        "n_words",
        hit.alias("n_hit"),
        F.size("_found").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_found")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that share no span with the benchmark, in their own columns.

    Null and empty texts stay, repeated rows stay or go together, and columns of any name are kept. Without
    documents there are no rows, without items all stay.
    """
    return unfolded(find_overlaps(docs, items, keep=True).where("NOT contaminated"), docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT rid, item, i, dw.k FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
