"""Operator 10: near-duplicates by bottom-k sketches of one hash function.

A document is its set of hashed word shingles; its sketch is the SKETCH smallest hashes. Documents of
one set are one node. Values of the sketches form inverted lists; two sets of similarity 0.8 share at
least SHARED of their retained values (but for a chance of 6e-7), so it is enough that
each enters the lists of its rarest ``size - SHARED + 1`` values, in an order that is the same for
all. Rarity is read from a histogram of BUCKETS counts over all sketches, a size that is fixed. Sets that are
not larger than a sketch are found without that chance; with ``sketch=None`` all sets are their own sketches
and the whole search is exact.

Rounds keep the lists from giving all pairs. In each of ROUNDS rounds every list has a head, and each node
is compared with the head of most of its lists; after a round only lists that hold nodes of several components
go on. At last these give all pairs that are not connected yet. Pairs are left out where the sizes, the places in
the lists or the parities (of members by their last bits, which differ in no more places than the sets in members)
show that too little is shared, filtered by the sketch of their union and confirmed on the full sets, which the sketches are where a set has no more than SKETCH
values; components come from repeated joins of tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewin.llm.common import broadcast_small, discard, materialize, table
from slicewin.llm.textscan import SPACED, Words, grams, portions, stretches

SKETCH, SHARED = 128, 79
BUCKETS = 1 << 16
ROUNDS = 3
#: Longs of a set's parity: for each value of some last bits whether an odd number of members has them.
PARITY = 16


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed numbers."""
    for _, data, offsets in stretches(column):
        w = Words(data, offsets, SPACED)
        for t in range(len(offsets) - 1):
            a, b = int(w.first[t]), int(w.first[t + 1])
            n = min(k, b - a)
            yield np.unique(grams(w.hashes[a:b], n).view(np.int64)) if n else np.zeros(0, np.int64)


def lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), pa.int64()))


def sketches(docs: DataFrame, k: int, sketch: int | None, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            n, sig, small, parity = [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                sig.append(hashlib.md5(s.tobytes()).digest())
                small.append(s[:sketch])
                bits = np.bincount(s & (64 * PARITY - 1), minlength=64 * PARITY) & 1
                parity.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists(small), lists(parity)], names=["doc_id", "n", "sig", "sketch", "parity"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, sig binary, sketch array<long>, parity array<long>")


def rarity(nodes: DataFrame) -> np.ndarray:
    """How often values of each bucket are retained, over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(v & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = nodes.select("sketch").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def required(na: Column, nb: Column, percent: int, sketch: int | None) -> Column:
    """The least number of retained values that sets of these sizes share if they are similar."""
    whole = F.ceil((na + nb) * percent / (100 + percent))
    if sketch is None:
        return whole
    return F.when(F.greatest(na, nb) <= sketch, whole).otherwise(F.least(F.lit(SHARED), F.ceil(F.greatest(na, nb) * percent / 100)))


def alike(na: Column, nb: Column, pa_: Column, pb: Column, percent: int) -> Column:
    """Whether the parities differ in no more places than similar sets differ in members; no similar pair fails."""
    apart = sum(F.bit_count(F.get(pa_, F.lit(i)).bitwiseXOR(F.get(pb, F.lit(i)))) for i in range(PARITY))
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def compatible(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def inverted(nodes: DataFrame, counts: np.ndarray, percent: int, sketch: int | None) -> DataFrame:
    """(value, node, n, left): left counts the values from this on, in the order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            rows, value, left = [], [], []
            flat, at = b.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            for i in range(b.num_rows):
                v = flat[at[i] : at[i + 1]]
                s = len(v)
                least = -(-percent * s // 100)
                take = s - (least if sketch is None else min(SHARED, least)) + 1
                v = v[np.lexsort((v, counts[v & (BUCKETS - 1)]))][:take]
                rows.append(np.full(take, i))
                value.append(v)
                left.append(s - np.arange(take))
            if rows:
                i = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value)), *[b.column(c).take(i) for c in range(2)], pa.array(np.concatenate(left).astype(np.int32))], names=["value", "node", "n", "left"])

    return nodes.select("node", "n", "sketch").mapInArrow(run, f"value long, node {dict(nodes.dtypes)['node']}, n long, left int")


def alive(rows: DataFrame) -> DataFrame:
    """The rows (value, node, n, left, leader) of lists in which several components are."""
    several = rows.groupBy("value").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo <> hi").select("value")
    return rows.join(several, "value")


def led(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with each node's leader: the smallest node that ``links`` connect it with."""
    found = components(links)
    return rows.drop("leader").join(found.withColumnRenamed("component", "leader"), "node", "left").withColumn("leader", F.coalesce("leader", "node"))


def untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """``pairs`` (a, b, ...) but for those compared before, in either order."""
    if tried is None:
        return pairs
    done = tried.union(tried.select("b", "a")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def with_heads(rows: DataFrame, turn: int, percent: int, sketch: int | None, tried: DataFrame | None) -> DataFrame:
    """(a, b): each node with the head of most of those of its lists in which the two may be similar.

    At first the head of a list is the node with the fewest rarer values, later one by a hash.
    """
    row = F.struct("node", "n", "left", "leader")
    head = F.max_by(row, F.struct("left", "node")) if turn == 0 else F.min_by(row, F.xxhash64("node", F.lit(turn)))
    x = rows.join(rows.groupBy("value").agg(head.alias("h")), "value").where(F.col("leader") != F.col("h.leader"))
    x = x.where(compatible(F.col("n"), F.col("h.n"), percent) & (F.least("left", F.col("h.left")) >= required(F.col("n"), F.col("h.n"), percent, sketch)))
    each = untried(x.groupBy(F.col("node").alias("a"), F.col("h.node").alias("b")).agg(F.count(F.lit(1)).alias("c")), tried)
    return each.groupBy("a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))


def both_sides(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b) with x and y, the column ``name`` of their nodes: only what pairs need is shuffled, by pair."""
    sides = []
    for own in ("a", "b"):
        keyed = broadcast_small(pairs.select(F.col(own).alias("node"), "a", "b"), 48)
        sides.append(values.select("node", name).join(keyed, "node").select("a", "b", F.lit(own == "a").alias("first"), name))
    mine = F.first(F.when(F.col("first"), F.col(name)), ignorenulls=True), F.first(F.when(~F.col("first"), F.col(name)), ignorenulls=True)
    return sides[0].unionByName(sides[1]).groupBy("a", "b").agg(mine[0].alias("x"), mine[1].alias("y"))


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, sketch: int | None, id_col: str, text_col: str) -> DataFrame:
    """The written ``pairs`` (a, b) whose sets are similar enough: by parity, by the union's sketch, then by the full sets."""
    slim = nodes.select("node", F.struct("n", "parity").alias("slim"))
    both = both_sides(pairs, slim, "slim")
    na, nb = F.col("x.n"), F.col("y.n")
    fit = compatible(na, nb, percent) & alike(na, nb, F.col("x.parity"), F.col("y.parity"), percent)
    near = materialize(both.where(fit).select("a", "b"), "near")
    both = both_sides(near, nodes.select("node", F.struct("n", "sketch").alias("own")), "own")
    x, y = F.col("x.sketch"), F.col("y.sketch")
    common = F.size(F.array_intersect(x, y))
    whole = F.lit(True) if sketch is None else (na <= sketch) & (nb <= sketch)
    similar = 100 * common >= percent * (na + nb - common)
    if sketch is not None:
        met = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union(x, y)), 1, sketch), F.array_intersect(x, y)))
        similar = F.when(whole, similar).otherwise(met >= F.least(F.lit(SHARED), F.ceil(F.least(na, nb) * percent / 100)))
    close = materialize(both.where(similar).select("a", "b", whole.alias("whole")), "close")
    discard(near)
    if sketch is None:
        return close.select("a", "b")
    sure, rest = close.where("whole").select("a", "b"), close.where("NOT whole").select("a", "b")
    wanted = broadcast_small(materialize(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted"), 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), lists(list(shingle_sets(b.column(1), k)))], names=["node", "full"])

    kind = dict(nodes.dtypes)["node"]
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(wanted, "node", "left_semi")
    full = texts.mapInArrow(run, f"node {kind}, full array<long>")
    both = both_sides(rest, full, "full")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    out = materialize(sure.union(both.where((100 * common >= percent * union) & (union > 0)).select("a", "b")), "links")
    discard(close, wanted)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), by minimum labels and shortcuts."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "label")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", F.least("component", "c").alias("new"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("new"), F.col("component").alias("up"))
        step = step.join(jump, "new", "left").select("node", F.coalesce("up", "new").alias("component"), "old")
        step = materialize(step, "label")
        discard(label)
        label = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            discard(edges)
            return label


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Words are runs of other than space and \\t to \\r, with A-Z lower-cased; a set is the distinct
    k-word shingles, or the whole sequence if shorter. Null, empty and wordless texts have no set and
    are linked with nothing. A very long text is one set of 8 bytes a shingle. Rows of one doc_id are one node: if one of them is
    linked, all are; of fully repeated rows each is returned. Rows without doc_id stand alone (component null, kept).
    Other columns are not read. An empty table gives no rows. ``sketch`` is SKETCH, or None for an exact search.
    """
    if sketch not in (None, SKETCH):
        raise ValueError(f"sketch is {SKETCH} or None")
    docs = docs.select(F.col(id_col), F.col(text_col))
    found = materialize(sketches(docs, k, sketch, id_col, text_col), "sketch")
    used = found.where("n > 0 AND doc_id IS NOT NULL")
    nodes = materialize(used.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")), "nodes")
    rows = materialize(found.select("doc_id", "n", "sig"), "rows")
    discard(found)
    index = inverted(nodes, rarity(nodes), percent, sketch).withColumn("leader", F.col("node"))
    live = materialize(alive(index), "lists")
    links, tried = None, None
    for turn in range(ROUNDS):
        pairs = materialize(with_heads(live, turn, percent, sketch, tried), "pairs")
        fresh = confirm(pairs, nodes, docs, k, percent, sketch, id_col, text_col)
        links, tried = (fresh, pairs) if turn == 0 else (links.union(fresh), tried.union(pairs))
        if fresh.isEmpty():
            break
        next_ = materialize(alive(led(live, links)), "lists")
        discard(live)
        live = next_
    rest = materialize(live.join(nodes.select("node", "parity"), "node"), "rest")
    discard(live)
    x = rest.select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("leader").alias("la"), F.col("left").alias("ra"), F.col("parity").alias("ma"))
    y = rest.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("leader").alias("lb"), F.col("left").alias("rb"), F.col("parity").alias("mb"))
    # Sets share no more than what comes from this value on, and differ in no fewer members than their parities do.
    near = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & compatible(F.col("na"), F.col("nb"), percent)
    enough = (F.least("ra", "rb") >= required(F.col("na"), F.col("nb"), percent, sketch)) & alike(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), percent)
    pairs = materialize(untried(x.join(y, "value").where(near & enough).select("a", "b").distinct(), tried), "pairs")
    more = confirm(pairs, nodes, docs, k, percent, sketch, id_col, text_col)
    discard(rest)
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").select("sig", F.col("doc_id").alias("a")).join(nodes.select("sig", F.col("node").alias("b")), "sig").where("a <> b").select("a", "b")
    part = components(links.union(more).union(copies))
    discard(nodes)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group, in their own columns; one row of each group.

    Rows of one doc_id are in one group, of which the first text by hash stays. Rows without doc_id are
    compared like others under keys of their own, after all ids; doc_id is a whole number or a string.
    """
    known = docs.where("doc_id IS NOT NULL").withColumn("_key", F.col("doc_id"))
    lone = docs.where("doc_id IS NULL")
    if dict(docs.dtypes)["doc_id"] == "string":
        key = F.concat(F.lit("\U0010FFFF"), F.monotonically_increasing_id().cast("string"))
    else:
        last = known.agg(F.max("doc_id").cast("long")).first()[0]
        known = known.withColumn("_key", F.col("_key").cast("long"))
        key = F.monotonically_increasing_id() + F.lit(max(last or 0, 0) + 1)
    keyed = known.unionByName(materialize(lone.withColumn("_key", key), "lone"))
    keep = near_duplicates(keyed, k, id_col="_key").where("kept").select("doc_id").distinct().withColumnRenamed("doc_id", "_key")
    kept = keyed.join(keep, "_key", "left_semi")
    often = materialize(keyed.groupBy("_key").count().where("count > 1").select("_key"), "often")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("text"), "text"))
    once = kept.join(often, "_key", "left_semi").withColumn("_turn", turn).where("_turn = 1")
    return kept.join(often, "_key", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.component_id, d.doc_id = q.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) q USING (doc_id)
"""
