"""Structured Streaming: idempotent ingest, settled windows and a change feed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, a bounded number at a time; times are read as UTC."""
    s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once, as long as its repeats come within the delay: resumable by checkpoint, idempotent by key."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def settled_counts(stream: DataFrame, ts: str, window: str, settle: str, *by: str) -> DataFrame:
    """Counts and sums per window, final once the window is older than the settling time."""
    return stream.withWatermark(ts, settle).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def change_feed(stream: DataFrame, state: str, emit: Callable[[list], None], checkpoint: str):
    """Calls ``emit`` with the (id, state) pairs that differ from what was emitted before, per micro-batch.

    Ids are entries of the catalog (data sets or runs), so there are few; what is
    compared is the latest row of the batch. What was emitted is a table beside
    the checkpoint, one folder per batch: after a restart nothing is emitted
    twice, and a batch that is run again compares with the batches before it.
    """
    store = f"{checkpoint.rstrip('/')}/emitted"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        last = df.groupBy("id").agg(F.max_by(state, "ts").alias(state))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        new = last
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            before = spark.read.schema(f"id long, {state} string, batch long").parquet(store).filter(F.col("batch") < number)
            known = before.groupBy("id").agg(F.max_by(state, "batch").alias("_known"))
            new = last.join(known, "id", "left").filter(~F.col(state).eqNullSafe(F.col("_known"))).drop("_known")
        rows = [(r["id"], r[state]) for r in new.orderBy("id").collect()]  # one row per id that changed in this batch
        if rows:
            emit(rows)
            spark.createDataFrame(rows, f"id long, {state} string").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def run_to_table(df: DataFrame) -> DataFrame:
    """An append stream over what is there now, run to its end, as a table in the shared folder; no row meets the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """An aggregating stream over what is there now, run to its end; its few groups are held by the driver."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
