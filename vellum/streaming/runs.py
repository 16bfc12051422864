"""Structured Streaming over run outputs (ST1-ST5).

Sources are file streams (new Parquet / CSV files in a folder); every query
is checkpointed in the shared checkpoint folder and written through
``foreachBatch`` to a Parquet table (no driver-side memory sink).  A micro-batch
may run again after a failure: each writes its own ``epoch=`` partition and
replaces it, so a table never holds a batch twice, and readers of another epoch
are not disturbed.  Tests and the query catalog drive them with
``trigger(availableNow=True)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.runs import FAILED_STATUS


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int = 4) -> DataFrame:
    """New files of a folder as a stream (a few files per micro-batch)."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
            .load(folder))


def stream_progress(outputs: DataFrame, run: str = "run_id") -> DataFrame:
    """ST1: live processed / failed counts per run (stateful aggregate)."""
    return outputs.groupBy(run).agg(F.count(F.lit(1)).alias("processed"),
                                    F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failed"))


def stream_throughput(outputs: DataFrame, window: str = "1 day", slide: str | None = None,
                      watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """ST2: requests, failures and mean response time per event-time window
    (tumbling, or sliding when ``slide`` is given); rows later than the
    watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (outputs.withWatermark(ts, watermark).groupBy(w.alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failures"),
                 F.avg("response_time_ms").alias("mean_response_ms"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", "failures", "mean_response_ms"))


def alerts(throughput: DataFrame, limit: float) -> DataFrame:
    """ST3: windows whose failure rate passes the limit."""
    rate = F.col("failures") / F.col("requests")
    return throughput.withColumn("failure_rate", rate).filter(F.col("failure_rate") > F.lit(limit))


def dedup_reruns(outputs: DataFrame, keys: list[str], watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """ST5: a re-run must not count a row twice: keys seen within the
    watermark are dropped (state is purged as the watermark passes)."""
    return outputs.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def epoch_sink(out_path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes a batch as its epoch's partition,
    replacing what an earlier attempt at the same epoch left."""
    def sink(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return sink


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Run a streaming query to the end of the available input
    (``availableNow``) into a Parquet table with a partition per epoch."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(epoch_sink(out_path, transform)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def read_result(spark: SparkSession, out_path: str, mode: str, keys: list[str] = ()) -> DataFrame:
    """The state of a table that ``run_to_table`` wrote: all rows (``append``),
    those of the last epoch (``complete``) or of each key's last one (``update``)."""
    rows = spark.read.parquet(out_path)
    if mode == "append":
        return rows.drop("epoch")
    if mode == "complete":
        return rows.filter(F.col("epoch") == rows.agg(F.max("epoch")).scalar()).drop("epoch")
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_last"))
    return last.select(*keys, "_last.*")


def ingest_stream(spark: SparkSession, drop_folder: str, store, dataset_id, checkpoint: str,
                  report_path: str, max_files: int = 100, settle: str | None = None) -> str:
    """ST4: CSV sources arriving in a drop folder are drift-checked and
    appended (S4) micro-batch by micro-batch.  A source is a file or a folder of
    part files directly under the drop folder, as in S5; names that the gate refuses
    are reported.

    What was taken is known by file (path, length, modification time), in the store's own log: a
    file is taken once, also when a batch runs again or the checkpoint is lost; a part that comes
    after its source was taken, and a file written again under a name that was taken, is an upload of its
    own, reported as late.  With ``settle`` a source waits until none of its files has changed for that long.
    A listing at the end takes what the stream itself doesn't show (files written again, sources that
    were still waiting).  Only names of a batch reach the driver, and paths of late parts.
    """
    from vellum.sources.ingest import REPORT_SCHEMA, source_in

    folder = drop_folder.rstrip("/")
    listing = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                            T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = (spark.readStream.format("binaryFile").schema(listing).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", max_files).load(folder).select("path"))

    def take(names: list[str] | None, path: str, mode: str) -> None:
        reps = store.upload_new(dataset_id, folder, names, settle=settle)
        if reps:
            spark.createDataFrame(reps, REPORT_SCHEMA).write.mode(mode).parquet(path)

    def sink(batch: DataFrame, epoch: int) -> None:
        names = sorted(r["source"] for r in batch.select(source_in(folder).alias("source")).distinct().collect())
        take(names, f"{report_path}/epoch={epoch}", "overwrite")

    q = (files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    take(None, f"{report_path}/epoch=-1", "append")
    return report_path
