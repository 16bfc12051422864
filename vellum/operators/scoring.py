"""Resumable scoring (H2 / H3): a run that was killed goes on where it stopped.

Rows are dealt into buckets by a hash of (run, row); a bucket, or a part of one that holds many bytes, is the unit of work and
of commit. Its task writes the scored rows as a file of its own, which comes into place when the task ends (output committer 2), so what
finished tasks scored survives the death of the job.  A finished wave is logged by (run, bucket).  The
next call leaves out logged buckets, then rows that stand in the data (anti-join on run and row), and scores
only what is left.  A row of a task that died before it ended was not committed and is scored again.

Each call is a wave with a number of its own; of a row that was scored in several waves (dead letters that
are tried again) the last counts, so writing a wave twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.hooks import SCORE_FIELDS, score_batches

# Bytes of text that one task scores, about: buckets of more are dealt to several tasks.
PART_BYTES = 64 << 20

LOG = "run_key string, bucket long, wave long, rows long"


class ScoreLog:
    """Scores of runs below ``root``; ``run`` and ``row`` name the key columns."""

    def __init__(self, spark: SparkSession, root: str, run: str = "run_id", row: str = "row_id", buckets: int = 64):
        self.spark, self.root, self.run, self.row, self.buckets = spark, root.rstrip("/"), run, row, buckets

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except Exception as e:  # noqa: BLE001 -- nothing was scored yet
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _keyed(self, df: DataFrame) -> DataFrame:
        """With a run key that is never null, and the bucket."""
        key = F.coalesce(F.concat(F.lit("="), F.col(self.run).cast("string")), F.lit(""))
        return df.withColumns({"run_key": key, "bucket": F.pmod(F.xxhash64(self.run, self.row), F.lit(self.buckets)).cast("long")})

    def _stored(self, inputs: T.StructType) -> T.StructType:
        return T.StructType([*inputs.fields, *SCORE_FIELDS, T.StructField("run_key", T.StringType()), T.StructField("wave", T.LongType()),
                             T.StructField("bucket", T.LongType())])

    def remaining(self, inputs: DataFrame, again: tuple[str, ...] = ()) -> DataFrame:
        """The rows of ``inputs`` that no wave has scored; rows that ended in a state of ``again`` (such as
        ``dead_letter``) count as not scored."""
        rows = self._keyed(inputs)
        scored = self._read("scores", self._stored(inputs.schema))
        if not again:
            # Whole buckets first: their rows need no look at the data.
            done = self._read("log", T.StructType.fromDDL(LOG)).groupBy("run_key", "bucket").agg(F.sum("rows").alias("done"))
            asked = rows.groupBy("run_key", "bucket").agg(F.count(F.lit(1)).alias("asked"))
            rows = rows.join(asked.join(done, ["run_key", "bucket"]).filter("done = asked").select("run_key", "bucket"), ["run_key", "bucket"], "left_anti")
        last = self._last(scored).filter(~F.col("status").isin(*again)) if again else scored
        seen = last.select(F.col("run_key").alias("_run"), F.col(self.row).alias("_row")).distinct()
        return rows.join(seen, (F.col("run_key") == F.col("_run")) & F.col(self.row).eqNullSafe(F.col("_row")), "left_anti").select(*inputs.columns, "run_key", "bucket")

    def _parts(self, inputs: DataFrame) -> int:
        """How many tasks a bucket is dealt to: by the bytes of all inputs' texts."""
        texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in inputs.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
        size = sum(texts, F.lit(8).cast("long") * len(inputs.columns))
        return max(1, -(-(inputs.agg(F.sum(size)).first()[0] or 0) // (self.buckets * PART_BYTES)))

    def score(self, inputs: DataFrame, scorer: Callable[[pd.DataFrame, int], pd.DataFrame], again: tuple[str, ...] = (), **how) -> DataFrame:
        """Scores what remains of ``inputs`` (one row per run and row) and returns the scores of all of
        its runs; ``how`` is passed to ``score_batches``."""
        schema = self._stored(inputs.schema)
        wave = (self._read("scores", schema).agg(F.max("wave")).first()[0] or 0) + 1
        parts = self._parts(inputs)
        part = F.pmod(F.hash(self.run, self.row), F.lit(parts))
        left = self.remaining(inputs, again)
        # Parts are dealt by their number: by a hash several would meet in one task.  Whole buckets are small enough for that,
        # and keep their chunks.
        left = left.repartitionById(self.buckets * parts, (F.col("bucket") * parts + part).cast("int")) if parts > 1 else left.repartition(self.buckets, "bucket")
        scored = score_batches(left, scorer, **how).withColumn("wave", F.lit(wave).cast("long"))
        # one file a bucket or part, in place as soon as its task ends
        (scored.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("bucket").parquet(f"{self.root}/scores"))
        new = self._read("scores", schema).filter(F.col("wave") == wave)
        (new.groupBy("run_key", "bucket").agg(F.lit(wave).cast("long").alias("wave"), F.count(F.lit(1)).alias("rows"))
         .coalesce(1).write.mode("append").parquet(f"{self.root}/log"))
        return self.scores(inputs)

    def _last(self, scored: DataFrame) -> DataFrame:
        values = [c for c in scored.columns if c not in ("run_key", "bucket", self.row)]
        last = scored.groupBy("run_key", "bucket", self.row).agg(F.max_by(F.struct(*values), "wave").alias("_last"))
        return last.select("run_key", "bucket", self.row, "_last.*")

    def scores(self, inputs: DataFrame) -> DataFrame:
        """Input columns and score of every scored row of the inputs' runs."""
        runs = self._keyed(inputs).select("run_key").distinct()
        stored = self._read("scores", self._stored(inputs.schema)).join(runs, "run_key", "left_semi")
        return self._last(stored).select(*inputs.columns, *[f.name for f in SCORE_FIELDS])
