"""Structured Streaming: running dedupe, judgements, keyed upserts and event-time windows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.writes import last_wins
from ..shared import shared_base

UPSERT_BUCKETS = 32


def shared(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a folder of files, or of one file, which a stream takes as the only match in its folder."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it has written."""
    spark, out = stream.sparkSession, shared(stream.sparkSession, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    else:

        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)


def running_dedupe(events: DataFrame, keys: list[str], at: str | None = None, within: str = "1 day") -> DataFrame:
    """The first event of each key; with a column of event time, keys are forgotten after a while, so the state stays bounded."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys) if at else events.dropDuplicates(keys)


def judged(requests: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Each request of a stream with its recorded answer, unknown where there is none; nothing is kept between batches."""
    return requests.join(recorded, key, "left").withColumn("operation_type", F.coalesce("operation_type", F.lit("unknown")))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their sum by window and type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def _versions(spark: SparkSession, base: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket among whole versions, before a batch if one is given; read from storage, so a restart finds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    out: dict[int, tuple[int, str]] = {}
    if not fs.exists(root):
        return {}
    for v in fs.listStatus(root):
        number = re.fullmatch(r"v(\d+)", v.getPath().getName())
        if not number or (before is not None and int(number[1]) >= before) or not fs.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            continue
        for b in fs.listStatus(v.getPath()):
            bucket = re.fullmatch(r"bucket__=(\d+)", b.getPath().getName())
            if bucket:
                k, n = int(bucket[1]), int(number[1])
                if k not in out or out[k][0] < n:
                    out[k] = n, b.getPath().toString()
    return {k: p for k, (_, p) in out.items()}


def upsert_sink(stream: DataFrame, keys: list[str], order: list[str], base: str | None = None) -> DataFrame:
    """Keep the last row of each key under base and give the table; with the same base a stream goes on where it stopped.

    Keys fall into UPSERT_BUCKETS buckets. A batch rewrites the buckets that it touches, as a version
    named by its number, from the versions before it, so a repeated batch does no harm.
    """
    spark = stream.sparkSession
    base = base or shared(spark, "upsert")
    schema = stream.schema

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(UPSERT_BUCKETS)).cast("int"))
        touched = [r[0] for r in rows.select("bucket__").distinct().collect()]  # UPSERT_BUCKETS at most
        old = _versions(spark, f"{base}/table", before=n)
        for k in touched:
            if k in old:
                rows = rows.unionByName(spark.read.schema(schema).parquet(old[k]).withColumn("bucket__", F.lit(k)))
        last_wins(rows, keys, order).write.mode("overwrite").partitionBy("bucket__").parquet(f"{base}/table/v{n}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    now = _versions(spark, f"{base}/table")
    return spark.read.schema(schema).parquet(*now.values()) if now else spark.createDataFrame([], schema)
