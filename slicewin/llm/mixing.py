"""Operator 3: mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within its source it belongs to a key range; the sizes of the
ranges are summed up (a prefix sum over few rows), and within a range a window adds up the sizes in
key order. The two give each document its place in its source's stream of words, and the stream is
cut at the source's exact budget, after as many whole epochs as the budget holds.

Sources are split into ranges in proportion to their rows, so a source that holds a third of all rows
is spread over a third of the ranges. Only tables with a row for each source, or each range, are
smaller than the documents; they are joined by ordinary joins, of which Spark broadcasts those whose
measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewin.llm.common import materialize, shuffle_partitions, table, unfolded, whole_row

WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to which weight and target are added.

    The targets share the total by weight; none exceeds ``most`` times its source's size, and what
    lies beyond is shared again by weight. In order of size/weight the sources are filled one after
    the other; the level of the others is the largest of the levels met on the way.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", w.cast("long")).withColumn("most", F.col("source_size") * most)
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = x.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    x = x.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("level", F.max(F.col("left_size").cast("double") / F.col("left_weight").cast("double")).over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return x.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    size: words of the text (runs of other than space and \\t to \\r; null: 0). taken: words that the
    mix takes of the document, over all epochs; at the cut a document is taken in part. Documents
    with a null source are a source of their own, the last. Repeated rows each count; equal rows
    share ties in any order, which gives the same rows. Other columns are not read. An empty table
    gives no rows, a table without words takes nothing.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), key.alias("key")), "mixing")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(stats.select("source", "source_size"), weights, most)
    every = Window.partitionBy()
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") * (4 * shuffle_partitions(spark)) / F.sum("n").over(every)))
    ranges = stats.select(F.col("source").alias("s"), ranges.cast("long").alias("ranges"))
    point = F.conv(F.substring("key", 1, 6), 16, 10).cast("long")
    split = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")), "left")
    split = split.withColumn("range", F.floor(point * F.col("ranges") / F.lit(1 << 24))).drop("s", "ranges")
    sums = split.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("first", F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum"))
    budget = F.floor("target")
    sums = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"),
        F.col("range").alias("g"),
        "first",
        "source_size",
        "target",
        F.coalesce(F.expr("try_divide(floor(target) - pmod(floor(target), nullif(source_size, 0)), source_size)"), F.lit(0)).cast("long").alias("epochs"),
        budget.alias("budget"),
    )
    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = split.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - (F.col("first") + F.col("within"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it; a part taken at the cut counts as one.

    Rows of one doc_id and source share what the mix takes of them evenly. Documents without words (null and empty
    texts too) carry no weight in the mix and stay once. Null ids and sources are values like others; columns of any
    name are kept. An empty table gives no rows.
    """
    taken = mix(docs, weights, most).groupBy("doc_id", "source").agg(F.sum("taken").alias("words"), F.sum("size").alias("all"))
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.coalesce(F.expr("try_divide(words, all)"), F.lit(1.0)).alias("share"))
    rows = docs.select(F.col("doc_id").alias("own"), F.col("source").alias("from"), whole_row(docs).alias("row"))
    rows = rows.join(taken, F.col("own").eqNullSafe(F.col("id")) & F.col("from").eqNullSafe(F.col("of")))
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(1), F.ceil("share").cast("int"))))
    return unfolded(rows, docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
         3 * source_size AS most FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(most) OVER b, 0) AS BIGINT) AS left_size,
         CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight
  FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(most AS DOUBLE), weight * max(CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE)) OVER ()) AS target FROM l),
c AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d)
SELECT p.doc_id, p.size, c.source_size, c.target,
       CAST(c.epochs * p.size + greatest(0, least(p.size, c.budget - c.epochs * c.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""
