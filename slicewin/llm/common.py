"""What the operators of this subpackage share: tables, a place for intermediate results, literals."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and Spark runs on one machine (tests), a
    temporary folder of this machine is made once and kept in the session; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("slicewin.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='slicewin-')}"
        spark.conf.set("slicewin.shared.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/slicewin/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: results survive the loss of executors, are computed once however often
    they are read, and keep column pruning and filter pushdown (which ``checkpoint()`` loses).
    """
    return store(df, folder(df.sparkSession, label))


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these frames; call it when nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/slicewin/" in root:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its counted rows of ``row_bytes`` stay within ``limit``; else as it is, for a shuffle.

    ``df`` is counted, so it should be read from a written table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a name of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unfolded(df: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """The columns of ``whole_row`` again."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of the driver's as a literal in the plan; ``ddl`` as in ``'a int, b long'``.

    The caller answers for a bound on ``rows`` that does not grow with the data.
    """
    names = [c.split()[0] for c in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    item = F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ddl.split(', '))}>>"))
    return spark.range(1).select(item.alias("r")).select(*[F.col(f"r.{n}").alias(n) for n in names])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
