"""Streaming reading sources and idempotent sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trajecta.session import folder, folder_exists, scratch_path


def reading_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """A file stream of readings."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """Readings as JSON messages of a Kafka topic (needs the Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def rate_stream(spark: SparkSession, rows_per_second: int = 100, batches: int = 8) -> DataFrame:
    """Generated readings for smoke runs."""
    raw = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return raw.select(
        F.concat(F.lit("B"), F.col("value") % batches).alias("batch_id"), F.col("timestamp").alias("ts"),
        F.lit("value").alias("variable"), F.sin(F.col("value") / 10.0).alias("value"))


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Drop repeated readings that arrive within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def heartbeat(spark: SparkSession, path: str, schema: T.StructType, at: datetime, time: str = "ts", **values) -> None:
    """Append a file of one row that only moves the watermark of a file stream to ``at``:
    texts are empty and numbers 0 unless given, so no run or session takes it up."""
    blank = {T.StringType: "", T.DoubleType: 0.0, T.LongType: 0, T.IntegerType: 0}
    row = {f.name: values.get(f.name, at if f.name == time else blank.get(type(f.dataType))) for f in schema.fields}
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Process what is there now into a table of the shared folder; read it back.
    ``progress`` takes up the reports of the micro-batches."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(path)


PART = "_part"
BUCKETS = 64


def roll_forward(spark: SparkSession, aside: str, path: str) -> None:
    """Put every partition of a whole set-aside table in the place of the table's own, by one
    rename each.  Done again after a crash it goes on where it stopped: a partition
    is either still aside or already in place."""
    system, source = folder(spark, aside)
    top = folder(spark, path)[1]
    system.mkdirs(top)
    for status in system.listStatus(source):
        name = status.getPath().getName()
        if name.startswith(f"{PART}="):
            target = folder(spark, f"{path}/{name}")[1]
            system.delete(target, True)
            if not system.rename(status.getPath(), target):
                raise RuntimeError(f"cannot put {name} in place")
    system.delete(source, True)


def upsert_rows(rows: DataFrame, epoch: int, path: str, keys: Sequence[str], part: Column) -> None:
    """Replace the keys of ``rows`` in the table at ``path``, which lies in partitions by ``part``.

    The touched partitions are merged aside under the epoch's number first.  Only when
    they are whole (Spark's success mark) do they take the old ones' place, so a crash
    at any point loses nothing: replaying the epoch finds the whole set aside and
    rolls it forward, or merges anew from a table that is still as it was.
    """
    spark = rows.sparkSession
    aside = f"{path}.aside-{epoch}"
    if not folder_exists(spark, f"{aside}/_SUCCESS"):
        fresh = rows.withColumn(PART, part)
        schema = T.StructType([*rows.schema.fields, T.StructField(PART, T.StringType())])
        merged = fresh.withColumn("_new", F.lit(1))
        if folder_exists(spark, path):
            touched = fresh.select(PART).distinct()
            old = spark.read.schema(schema).parquet(path).join(touched, PART, "left_semi")
            merged = merged.unionByName(old.withColumn("_new", F.lit(0)))
        # the newest row of a key, in one shuffle
        newest = merged.groupBy(PART, *keys).agg(F.max_by(F.struct(*rows.columns), "_new").alias("_row"))
        newest.select("_row.*", PART).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(aside)
    roll_forward(spark, aside, path)


def upsert(stream: DataFrame, path: str, state: str, keys: Sequence[str], mode: str = "update",
           part: Column | None = None) -> StreamingQuery:
    """Start a sink that keeps one row per key, in partitions by ``part`` (a function of the
    key; if not given, ``BUCKETS`` shares of the first key's values, the runs, so that the
    folders don't grow with the runs).  A micro-batch rewrites only the partitions
    it touches, and replaying one changes nothing."""
    keys = list(keys)
    part = (F.pmod(F.xxhash64(keys[0]), F.lit(BUCKETS)) if part is None else part).cast("string")
    part = F.when(part != "", part).otherwise("none")  # NULL and empty are no names of a folder
    return (
        stream.writeStream.foreachBatch(lambda rows, epoch: upsert_rows(rows, epoch, path, keys, part)).outputMode(mode)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def upsert_now(stream: DataFrame, name: str, keys: Sequence[str], mode: str = "update",
               part: Column | None = None) -> DataFrame:
    """Upsert what is there now and read the table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    upsert(stream, path, scratch_path(spark, f"{name}-state"), keys, mode, part).awaitTermination()
    columns = [f.name for f in stream.schema.fields]
    schema = T.StructType([*stream.schema.fields, T.StructField(PART, T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*columns)


def complete_now(stream: DataFrame, name: str) -> DataFrame:
    """The whole result of what is there now, open windows and sessions included."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode("complete").option(
        "checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
