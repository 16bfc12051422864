"""Run anomalies while data comes in (W4 on a stream, beside the fixed limit of ST3).

Two stages in append mode: rows are counted per run and period, natively and with map-side combine, and a period is
passed on once the watermark has closed it; a ring buffer of each run's trailing periods gives each closed period
its z-score.  Only a row per run and period reaches the second stage, so a run with a third of all rows is no hot key.
Runs are dealt by hash to ``shards`` keys of state; a shard's ring buffers are one packed table, so a micro-batch costs a
state read and write a shard and array operations, however many runs there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vellum.operators.runs import FAILED_STATUS
from vellum.session import ship_code
from vellum.streaming.progress import SHARDS, packed, run_of, run_text, unpacked, use_state_store

RESULT = "run_text string, period long, n long, failures long, failure_rate double, z double, anomalous boolean"


def score_periods(of: np.ndarray, rates: np.ndarray, trail: np.ndarray, held: np.ndarray) -> np.ndarray:
    """z of each rate (NaN without a spread) against the run's periods before, where ``of`` is its run and rates come by run
    and period.  ``trail`` (a row a run, the newest at the end) and ``held`` (how many there are) go on in place."""
    z, width = np.full(len(rates), np.nan), trail.shape[1]
    turn = pd.Series(of).groupby(of).cumcount().to_numpy()  # a run's first period, its second ...
    for at in (np.flatnonzero(turn == k) for k in range(turn.max(initial=-1) + 1)):
        runs, rate = of[at], rates[at]
        old, n = trail[runs], held[runs]
        there = np.arange(width) >= width - n[:, None]
        mean = (old * there).sum(axis=1) / np.maximum(n, 1)
        spread = np.sqrt((((old - mean[:, None]) * there) ** 2).sum(axis=1) / np.maximum(n - 1, 1))
        # a spread below 1e-9 counts as none
        some = (n > 1) & (spread > 1e-9)
        z[at[some]] = (rate[some] - mean[some]) / spread[some]
        trail[runs] = np.concatenate([old[:, 1:], rate[:, None]], axis=1)
        held[runs] = np.minimum(n + 1, width)
    return z


class _Trailing(StatefulProcessor):
    def __init__(self, trailing: int, z_limit: float, ttl_ms: int | None):
        self.trailing, self.z_limit, self.ttl_ms = trailing, z_limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # rates of the last periods of each run, the oldest first
        self.runs = handle.getValueState("runs", "packed binary", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["run_text", "period"], kind="stable").reset_index(drop=True)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        runs = unpacked(self.runs.get()[0]) if self.runs.exists() else None
        if runs is None:
            runs = pd.DataFrame({"run_text": pd.Series(dtype=object), "held": pd.Series(dtype="int64"), "put": pd.Series(dtype="int64"),
                                 **{f"r{i}": pd.Series(dtype="float64") for i in range(self.trailing)}})
        if self.ttl_ms:
            runs = runs[runs["put"] + self.ttl_ms > now].reset_index(drop=True)
        of, names = pd.factorize(pd.concat([runs["run_text"], new["run_text"]], ignore_index=True))
        of = of[len(runs):]
        trail, held, put = np.zeros((len(names), self.trailing)), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        trail[:len(runs)], held[:len(runs)], put[:len(runs)] = runs[[f"r{i}" for i in range(self.trailing)]], runs["held"], runs["put"]
        rates = (new["failures"] / new["n"]).to_numpy()
        z = score_periods(of, rates, trail, held)
        put[of] = now
        self.runs.update((packed(pd.DataFrame({"run_text": names, "held": held, "put": put, **{f"r{i}": trail[:, i] for i in range(self.trailing)}})),))
        # z is compared at 9 decimals, as in the batch report
        yield pd.DataFrame({"run_text": new["run_text"], "period": new["period"], "n": new["n"], "failures": new["failures"],
                            "failure_rate": rates, "z": z, "anomalous": np.abs(np.round(z, 9)) > self.z_limit})

    def close(self) -> None:
        pass


def stream_anomalies(outputs: DataFrame, run: str = "run_id", ts: str = "ts", period: str = "1 day", watermark: str = "1 hour", *,
                     trailing: int = 7, z_limit: float = 2.0, ttl: str | None = None, shards: int = SHARDS) -> DataFrame:
    """Closed periods of every run with failure rate, z-score against the run's ``trailing`` periods before and flag, in
    append mode.  ``ttl``: how long the trailing periods of a silent run are kept."""
    spark = outputs.sparkSession
    use_state_store(spark)
    ship_code(spark)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    per = (outputs.withWatermark(ts, watermark).groupBy(F.col(run).alias("run_id"), F.window(ts, period).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failures"))
           .select(run_text(F.col("run_id")).alias("run_text"), F.unix_micros(F.col("w.start").cast("timestamp")).alias("period"), "n", "failures"))
    sharded = per.withColumn("shard", F.pmod(F.xxhash64("run_text"), F.lit(shards)))
    # A time to live goes by processing time, in which a stream always has another batch to run: it suits streams that go on.
    scored = sharded.groupBy("shard").transformWithStateInPandas(_Trailing(trailing, z_limit, ttl_ms), RESULT, outputMode="Append",
                                                                 timeMode="ProcessingTime" if ttl else "None")
    return scored.select(run_of("run_text", outputs.schema[run].dataType).alias("run_id"), F.timestamp_micros("period").alias("period"), "n", "failures",
                         "failure_rate", "z", "anomalous")
