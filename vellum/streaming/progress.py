"""Live progress of runs with ETA, over a stream of expected rows and one of outputs (ST1).

Both streams meet in one keyed state, so a row that is sent again counts once and by its last output, as in
the batch report (A9).  Figures are kept per (run, bucket); a bucket is a hash range of rows, so a run with a third of
all rows is spread over ``buckets`` partial sums, which ``progress_report`` adds up.  (run, bucket) pairs are dealt
by hash to ``shards`` keys of state: a shard holds a packed table of its pairs' rows (asked for, first and last output,
last status) and one of their sums.  A micro-batch costs a few state reads and writes a shard, however
many runs there are, and array operations over the shard's rows.

A timer on event time closes a pair that saw no row for ``idle``: its rows are dropped from the state,
its figures stay.  What comes later is counted as ``late`` and changes no figure.  A shard's timer is that of its pair
that is due first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vellum.functions import scalar as S
from vellum.operators.runs import FAILED_STATUS
from vellum.session import ship_code

# State of keyed processors lives in RocksDB; set before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Keys of state that runs are dealt to: their number bounds the calls a micro-batch makes, a shard's rows fit a task.
SHARDS = 128

_FIGURES = ["expected", "processed", "failed", "first", "last", "late", "closed"]
_ROWS = np.dtype([("pair", "<i4"), ("row", "<i8"), ("asked", "?"), ("done", "?"), ("first", "<i8"), ("last", "<i8"), ("status", "<i8")])
_NONE = np.iinfo(np.int64).max
# What a pair's figures start with.
_START = {"expected": 0, "processed": 0, "failed": 0, "first": _NONE, "last": -1, "late": 0, "closed": False, "due": -1}


def run_text(run: Column) -> Column:
    """A run's key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), run.cast("string")), F.lit(""))


def run_of(text: str, kind: T.DataType) -> Column:
    """The run that ``run_text`` made a text of."""
    return F.when(F.col(text) != "", F.substring(F.col(text), F.lit(2), F.length(text)).cast(kind))


def packed(df: pd.DataFrame) -> bytes:
    """A table as bytes of a state."""
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas()


def merge_rows(rows: np.ndarray) -> np.ndarray:
    """A packed table with one row a (pair, row), sorted by both; of equal times the later row gives the status."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["last"], rows["row"], rows["pair"]))]
    new = np.flatnonzero(np.r_[True, (rows["pair"][1:] != rows["pair"][:-1]) | (rows["row"][1:] != rows["row"][:-1])])
    out = rows[np.r_[new[1:], len(rows)] - 1]  # the last output of a row gives its status
    for name in ("asked", "done"):
        out[name] = np.logical_or.reduceat(rows[name], new)
    out["first"] = np.minimum.reduceat(rows["first"], new)
    return out


class _Progress(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "packed binary")
        self.pairs = handle.getValueState("pairs", "packed binary")
        self.timer = handle.getValueState("timer", "due long")

    def _set_timer(self, pairs: pd.DataFrame, old: int) -> None:
        due = pairs.loc[~pairs["closed"], "due"].min()
        due = -1 if pd.isna(due) else int(due)
        if due != old:
            if old >= 0:
                self.handle.deleteTimer(old)
            if due >= 0:
                self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        held = np.zeros(0, dtype=_ROWS)
        pairs = pd.DataFrame({"run_text": pd.Series(dtype=object), "bucket": pd.Series(dtype="int64"),
                              **{c: pd.Series(dtype=type(x)) for c, x in _START.items()}})
        if self.pairs.exists():
            pairs = unpacked(self.pairs.get()[0])
            held = np.frombuffer(self.rows.get()[0], dtype=_ROWS)
        names = pd.concat([pairs[["run_text", "bucket"]], new[["run_text", "bucket"]]], ignore_index=True)
        # numbers by first appearance: pairs that are held keep theirs
        at_pair = names.groupby(["run_text", "bucket"], sort=False).ngroup().to_numpy()[len(pairs):]
        names = names.drop_duplicates(ignore_index=True)
        pairs = pd.concat([names, *[pairs[c].reindex(names.index, fill_value=x) for c, x in _START.items()]], axis=1)
        closed = pairs["closed"].to_numpy(dtype=bool)
        late = closed[at_pair]
        pairs["late"] += np.bincount(at_pair[late], minlength=len(pairs))
        touched = np.unique(at_pair)

        at, asked = new["at"].to_numpy(dtype=np.int64), new["asked"].to_numpy(dtype=bool)
        more = np.zeros(len(new), dtype=_ROWS)
        more["pair"], more["row"], more["asked"], more["done"] = at_pair, new["row"].to_numpy(dtype=np.int64), asked, ~asked
        more["first"], more["last"], more["status"] = np.where(asked, _NONE, at), np.where(asked, -1, at), new["status"].to_numpy(dtype=np.int64)
        table = merge_rows(np.concatenate([held, more[~late]]))
        self.rows.update((table.tobytes(),))

        both = table["asked"] & table["done"]
        mine = table[both]
        first, last, seen = np.full(len(pairs), _NONE), np.full(len(pairs), -1), pairs["last"].to_numpy(dtype=np.int64, copy=True)
        np.minimum.at(first, mine["pair"], mine["first"])
        np.maximum.at(last, mine["pair"], mine["last"])
        np.maximum.at(seen, at_pair, at)
        figures = {"expected": np.bincount(table["pair"][table["asked"]], minlength=len(pairs)), "processed": np.bincount(mine["pair"], minlength=len(pairs)),
                   "failed": np.bincount(mine["pair"][mine["status"] >= FAILED_STATUS], minlength=len(pairs)), "first": first, "last": last,
                   "due": np.maximum(seen // 1000 + self.idle_ms, pairs["due"])}
        changed = np.zeros(len(pairs), dtype=bool)
        changed[touched] = True
        changed &= ~closed
        for name, values in figures.items():
            pairs[name] = np.where(changed, values, pairs[name]).astype(np.int64)
        self.pairs.update((packed(pairs),))
        self._set_timer(pairs, self.timer.get()[0] if self.timer.exists() else -1)
        yield pairs.loc[touched, ["run_text", "bucket", *_FIGURES]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pairs = unpacked(self.pairs.get()[0])
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over = (~pairs["closed"] & ((pairs["due"] <= fired) | (pairs["due"] < now))).to_numpy()
        pairs["closed"] |= over
        held = np.frombuffer(self.rows.get()[0], dtype=_ROWS)
        self.rows.update((held[~over[held["pair"]]].tobytes(),))
        self.pairs.update((packed(pairs),))
        self._set_timer(pairs, -1)
        yield pairs.loc[over, ["run_text", "bucket", *_FIGURES]]

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def live_progress(inputs: DataFrame, outputs: DataFrame, run: str = "run_id", row: str = "row_id", ts: str = "ts", *,
                  buckets: int = 16, watermark: str = "1 day", idle: str = "7 days", shards: int = SHARDS) -> DataFrame:
    """A stream of partial figures per (run, bucket): write it in update mode with
    ``run_to_table`` and read it with ``progress_report``.

    inputs: run, row, ts (when the row was asked for); outputs also have ``status_code``.  Rows without
    a time are left out, and rows later than the watermark are dropped by the stream.
    """
    spark = inputs.sparkSession
    use_state_store(spark)
    ship_code(spark)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def side(df: DataFrame, asked: bool) -> DataFrame:
        status = F.lit(0).cast("long") if asked else F.coalesce(F.col("status_code").cast("long"), F.lit(0))
        hashed = F.xxhash64(F.col(row))
        return df.select(run_text(F.col(run)).alias("run_text"), F.pmod(hashed, F.lit(buckets)).alias("bucket"), hashed.alias("row"), F.col(ts).alias("ts"),
                         F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), status.alias("status"), F.lit(asked).alias("asked")) \
            .filter(F.col("ts").isNotNull())

    both = side(inputs, True).unionByName(side(outputs, False)).withWatermark("ts", watermark)
    schema = "run_text string, bucket long, expected long, processed long, failed long, first long, last long, late long, closed boolean"
    sharded = both.withColumn("shard", F.pmod(F.xxhash64("run_text", "bucket"), F.lit(shards)))
    partials = sharded.groupBy("shard").transformWithStateInPandas(_Progress(idle_ms), schema, outputMode="Update", timeMode="EventTime")
    stamp = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < _NONE), F.timestamp_micros(F.col(c)))
    return partials.select(run_of("run_text", inputs.schema[run].dataType).alias("run_id"), "bucket", "expected", "processed", "failed",
                           stamp("first").alias("first_ts"), stamp("last").alias("last_ts"), "late", "closed")


def progress_report(partials: DataFrame, as_of=None) -> DataFrame:
    """Per run: expected, processed, failed, remaining, percent, ETA in seconds
    (elapsed since the first output / processed * remaining), late rows and whether the run is closed.

    ``as_of``: until when time has elapsed; by default until the run's last output."""
    per = partials.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("expected", "processed", "failed")], F.min("first_ts").alias("first_ts"),
                                         F.max("last_ts").alias("last_ts"), F.sum("late").alias("late"), F.min("closed").alias("closed"))
    until = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("last_ts")
    remaining = F.col("expected") - F.col("processed")
    elapsed = (F.unix_micros(until) - F.unix_micros("first_ts")) / 1e6
    return per.filter("expected > 0").select(
        "run_id", "expected", "processed", "failed", remaining.alias("remaining"), S.percent("processed", "expected").alias("percent"),
        F.when(F.col("processed") > 0, elapsed / F.col("processed") * remaining).alias("eta_seconds"), "late", "closed")
