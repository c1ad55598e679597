"""Where streams and tables come from and go to. Kafka needs its connector package on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def kafka_options(servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None, **more: str) -> dict[str, str]:
    """Options of the Kafka source; ``more`` go with the prefix ``kafka.``."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if per_trigger is not None:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out | {f"kafka.{k}": v for k, v in more.items()}


def decoded(messages: DataFrame) -> DataFrame:
    """key, value (whole numbers from their texts) and ts (timestamp) of Kafka messages; what is not a number becomes null."""
    text = lambda c: F.col(c).cast("string").try_cast("int").alias(c)
    return messages.select(text("key"), text("value"), F.col("timestamp").alias("ts"))


def from_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    return decoded(spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load())


def from_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    """A stream of the files that come to lie in ``path``."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).load(path)


def with_time(rows: DataFrame, time: str) -> DataFrame:
    """Rows without a time take that of their processing."""
    at = F.coalesce(F.col(time), F.current_timestamp()) if time in rows.columns else F.current_timestamp()
    return rows.withColumn(time, at)


def as_messages(results: DataFrame, keys: list[str]) -> DataFrame:
    """key and value texts for a topic: the keys' values, and the whole row as JSON."""
    key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
    return results.select(key.alias("key"), F.to_json(F.struct(*results.columns)).alias("value"))


def as_text(results: DataFrame) -> DataFrame:
    """One text for each window: its bounds, keys and values."""
    values = [c for c in results.columns if c not in ("spec", "start", "end")]
    shown: list[Column] = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in values]
    return results.select(F.concat(F.lit("["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(") "), F.concat_ws(" ", *shown)).alias("value"))


def _writer(results: DataFrame, mode: str, checkpoint: str | None, every_ms: int | None, once: bool) -> DataStreamWriter:
    out = results.writeStream.outputMode(mode)
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    if once:
        return out.trigger(availableNow=True)
    return out if every_ms is None else out.trigger(processingTime=f"{every_ms} milliseconds")


def to_console(results: DataFrame, mode: str = "update", every_ms: int | None = 999, once: bool = False):
    return _writer(results, mode, None, every_ms, once).format("console").option("truncate", False).start()


def to_memory(results: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, once: bool = True):
    return _writer(results, mode, checkpoint, None, once).format("memory").queryName(name).start()


def to_files(results: DataFrame, path: str, checkpoint: str, every_ms: int | None = None, once: bool = False, form: str = "parquet"):
    return _writer(results, "append", checkpoint, every_ms, once).format(form).start(path)


def to_kafka(results: DataFrame, servers: str, topic: str, checkpoint: str, keys: list[str], mode: str = "update", every_ms: int | None = 100):
    out = _writer(as_messages(results, keys), mode, checkpoint, every_ms, False)
    return out.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()
