"""Logs to read: the supplied tables seen as logs, Parquet files, and a broker where its connector is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Options


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of 12 partitions keyed by user.

    ``fails`` attempts of a record fail before one succeeds.  Offsets are
    counted here only because the table has none; a real log brings its own.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.expr("cast(user_id % 12 as int)"))
    return e.select(
        F.lit("events").alias("topic"), "part", F.col("user_id").alias("k"),
        (F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1).cast("long").alias("off"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", "value",
        F.expr("cast(if(event_type = 'error', 1 + event_id % 4, 0) as bigint)").alias("fails"),
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a log keyed by conversation, a turn being the offset."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.lit("conversations").alias("topic"), F.expr("cast(conv_id % 8 as int)").alias("part"), F.col("conv_id").alias("k"), F.col("turn").alias("off"), "role", "text")


def files(spark: SparkSession, path: str, schema, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A log in Parquet files, bounded or as a stream; ``files_per_trigger`` is the brake of a loaded stream."""
    if not stream:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def per_trigger(settings: Options, factor: int | None = None) -> int:
    """Records that make a stream sufficiently loaded: the target in flight times the load factor."""
    return settings.target * (factor or settings.load_factor())


def broker(spark: SparkSession, servers: str, topics: list[str] | None = None, pattern: str | None = None, stream: bool = True, offsets_per_trigger: int | None = None, settings: Options | None = None, **options: str) -> DataFrame:
    """A log of a broker, by a list of topics or a pattern; needs Spark's connector.  Spark keeps the offsets, so the client's own commits stay off.

    Without ``offsets_per_trigger`` a stream takes, at a time, what ``settings`` would hold ready.
    """
    if bool(topics) == bool(pattern):
        raise ValueError("give either topics or a pattern")
    if str(options.get("kafka.enable.auto.commit", "false")).lower() == "true":
        raise ValueError("offsets are kept by the engine: auto commit must be off")
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", ",".join(topics)) if topics else reader.option("subscribePattern", pattern)
    if stream and offsets_per_trigger is None and settings is not None:
        offsets_per_trigger = per_trigger(settings)
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("timestamp").alias("ts"), F.col("key").alias("k"), "value")
