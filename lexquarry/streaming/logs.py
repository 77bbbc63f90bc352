"""Structured Streaming over append-only tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.session import scratch_path


def file_stream(spark: SparkSession, table: str, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files of a table: a folder of files, or one file."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        single = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    except Exception:
        single = False
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream until its input ends and read the result; state and output lie in the shared folder."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events and their value by type and tumbling window; a window is final once the watermark passes it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def first_deliveries(rows: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """Rows of the first delivery of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: Parts of a folded table; a batch rewrites those it touches.
PARTS = 64


def latest_table(stream: DataFrame, merge: Callable[[DataFrame, DataFrame | None], DataFrame], keys: list[str], name: str) -> DataFrame:
    """Fold a stream into a table batch by batch: ``merge(batch, rows so far)`` is called with the rows of the parts
    (by hash of ``keys``) that the batch touches, and only these are written anew, under the number of the batch. A
    batch that is repeated after a failure reads what was there before it, so it gives the same table."""
    spark = stream.sparkSession
    base, mark = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    written: dict[int, list[int]] = {}  # of each part the batches that wrote it

    def read(session: SparkSession, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{base}/v{number}/part={part}" for part, number in sorted(versions.items())]
        return session.read.parquet(*paths) if paths else None

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        touched = [row.part for row in marked.select("part").distinct().collect()]
        before = read(batch.sparkSession, {part: max(past) for part in touched if (past := [n for n in written.get(part, []) if n < number])})
        merged = merge(batch, before).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{base}/v{number}")
        for part in touched:
            written.setdefault(part, []).append(number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    out = read(spark, {part: max(past) for part, past in written.items()})
    return spark.createDataFrame([], stream.schema) if out is None else out
