"""Tables that a stream keeps by key: the last row of a key (ST1) or its first (ST5, however late a row comes again).

An epoch writes its rows, one a key, as its own ``epoch=`` partition and replaces what an earlier attempt at it left.  Every
``fold_every`` epochs all rows so far are folded into one row a key; readers take the latest fold and the epochs after it, so
what a read opens is bounded however long the stream has run.  A fold counts once its marker, written last as one file,
is there.  State is a bucketed table in shared storage, not in the stream's memory: a key is known for good,
also after the watermark has passed or the checkpoint is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD_EVERY = 20
BUCKETS = 32


class EpochTable:
    """Rows by ``keys`` below ``path``; ``keep`` says which row of a key counts: ``last`` or ``first`` (by epoch,
    within an epoch by ``order``)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], keep: str = "last", order: str | None = None,
                 fold_every: int = FOLD_EVERY, buckets: int = BUCKETS):
        if keep not in ("first", "last"):
            raise ValueError("keep is 'first' or 'last'")
        self.spark, self.path, self.keys, self.keep, self.order = spark, path.rstrip("/"), list(keys), keep, order
        self.fold_every, self.buckets = fold_every, buckets

    # ------------------------------------------------------------- writing

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """A row a key: of several epochs the first or last one's."""
        values = [c for c in rows.columns if c not in (*self.keys, "epoch")]
        pick = F.max_by if self.keep == "last" else F.min_by
        at = F.struct("epoch", F.col(self.order)) if self.order else F.col("epoch")
        one = rows.groupBy(*self.keys).agg(pick(F.struct(*values, F.col("epoch").alias("_epoch")), at).alias("_one"))
        return one.select(*self.keys, *[F.col(f"_one.{c}") for c in values], F.col("_one._epoch").alias("epoch"))

    def sink(self, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        def write(batch: DataFrame, epoch: int) -> None:
            rows = (transform(batch) if transform else batch).withColumn("epoch", F.lit(epoch).cast("long"))
            self._one_each(rows).drop("epoch").write.mode("overwrite").parquet(f"{self.path}/epochs/epoch={epoch}")
            if (epoch + 1) % self.fold_every == 0:
                self.fold(epoch)
        return write

    def fold(self, upto: int) -> None:
        """Folds all epochs up to this one; an earlier attempt at the same fold is replaced."""
        rows = self._rows(upto)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        self._one_each(rows).repartition(self.buckets, bucket).write.mode("overwrite").parquet(f"{self.path}/folds/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/upto={upto}")

    # ------------------------------------------------------------- reading

    def _numbers(self, folder: str, name: str) -> list[int]:
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/{folder}")
            found = files.select(F.regexp_extract("path", rf"/{name}=([0-9]+)/part-[^/]+\.parquet$", 1).alias("v")).filter("v != ''").distinct().collect()
            return sorted(int(r["v"]) for r in found)
        except Exception as e:  # noqa: BLE001 -- nothing was written yet
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return []
            raise

    def parts(self, upto: int | None = None) -> tuple[int | None, list[int]]:
        """(the fold to start from, the epochs after it), up to an epoch."""
        fold = max((m for m in self._numbers("marks", "upto") if upto is None or m < upto), default=None)
        return fold, [e for e in self._numbers("epochs", "epoch") if (fold is None or e > fold) and (upto is None or e <= upto)]

    def _rows(self, upto: int | None = None) -> DataFrame | None:
        fold, epochs = self.parts(upto)
        rows = None
        if epochs:
            paths = [f"{self.path}/epochs/epoch={e}" for e in epochs]
            rows = self.spark.read.option("basePath", f"{self.path}/epochs").parquet(*paths).withColumn("epoch", F.col("epoch").cast("long"))
        if fold is not None:
            folded = self.spark.read.parquet(f"{self.path}/folds/upto={fold}")
            rows = folded if rows is None else folded.unionByName(rows)
        return rows

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """A row a key.  ``schema`` is what an empty table is read as."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        return self._one_each(rows).drop("epoch")


def run_to_keyed_table(stream: DataFrame, table: EpochTable, checkpoint: str, mode: str = "append",
                       transform: Callable[[DataFrame], DataFrame] | None = None) -> EpochTable:
    """Runs a stream to the end of the available input into a keyed table."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(table.sink(transform)).trigger(availableNow=True).start())
    q.awaitTermination()
    return table
