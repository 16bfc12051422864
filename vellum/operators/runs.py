"""Run analytics: per-run summaries, progress, cost, anomalies, metric
summaries, run comparison and trends.

Per-run figures are hash aggregates with map-side partial combine, so a run
holding a third of all rows is pre-aggregated in every task before the
shuffle.  Windows only run over already-aggregated tables (one row per run
and period or per run and metric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import scalar as S
from vellum.plans.prefix import exact_quantile

# A response with status >= 400 is a failure.
FAILED_STATUS = 400


def run_summary(outputs: DataFrame, run: str = "run_id", q: float = 0.95) -> DataFrame:
    """Per run: rows, failures, error rate, mean and exact p95 response time."""
    agg = outputs.groupBy(run).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failed"),
        F.avg("response_time_ms").alias("mean_response_ms"))
    p = exact_quantile(outputs, [run], "response_time_ms", q, "p95_response_ms")
    p = p.withColumnRenamed(run, "_run")
    return (agg.join(p, F.col(run).eqNullSafe(F.col("_run")), "left")
            .select(run, "rows", "failed", (F.col("failed") / F.col("rows")).alias("error_rate"),
                    "mean_response_ms", "p95_response_ms"))


def run_progress(inputs: DataFrame, outputs: DataFrame, as_of, run: str = "run_id",
                 row: str = "row_id") -> DataFrame:
    """Expected rows (inputs) against processed ones (outputs up to
    ``as_of``): processed, failed, remaining, percent and ETA seconds =
    elapsed / processed * remaining (elapsed from the run's first output)."""
    cut = F.lit(as_of).cast("timestamp_ntz")
    done = outputs.filter(F.col("ts") < cut).select(run, row, "ts", "status_code")
    # one output per row: a row sent again (a retry) counts by its last output
    done = done.groupBy(run, row).agg(F.min("ts").alias("ts"), F.max_by("status_code", "ts").alias("status_code"))
    j = inputs.select(run, row).distinct().join(done, [run, row], "left")
    agg = j.groupBy(run).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("ts").alias("processed"),
        F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failed"),
        F.min("ts").alias("_first"))
    elapsed = S.epoch_seconds_between("_first", cut)
    remaining = F.col("expected") - F.col("processed")
    return agg.select(
        run, "expected", "processed", "failed", remaining.alias("remaining"),
        S.percent("processed", "expected").alias("percent"),
        F.when(F.col("processed") > 0, elapsed / F.col("processed") * remaining).alias("eta_seconds"))


def whitespace_tokens(x) -> F.Column:
    """Whitespace token count (a stand-in, not a model tokenizer)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.size(F.filter(F.split(c, "[ \t\n\r\f]+"), lambda s: s != ""))


def run_cost(turns: DataFrame, rate_in: float, rate_out: float, key: str = "conv_id",
             role: str = "role", text: str = "text") -> DataFrame:
    """A10: input tokens (user turns) x rate + output tokens (assistant turns) x rate."""
    toks = whitespace_tokens(text)
    agg = turns.groupBy(key).agg(
        F.sum(F.when(F.col(role) == "user", toks).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col(role) == "assistant", toks).otherwise(0)).alias("output_tokens"))
    return agg.select(key, F.col("input_tokens").cast("bigint").alias("input_tokens"),
                      F.col("output_tokens").cast("bigint").alias("output_tokens"),
                      (F.col("input_tokens") * F.lit(rate_in) + F.col("output_tokens") * F.lit(rate_out)).alias("cost"))


def run_anomalies(outputs: DataFrame, run: str = "run_id", period: str = "day", trailing: int = 7,
                  z_limit: float = 2.0) -> DataFrame:
    """Failure rate per run and period, z-score against the trailing
    ``trailing`` periods of the same run; |z| > limit flags an anomaly."""
    per = (outputs.groupBy(run, F.date_trunc(period, "ts").alias("period"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failures"))
           .withColumn("failure_rate", F.col("failures") / F.col("n")))
    w = Window.partitionBy(run).orderBy("period").rowsBetween(-trailing, -1)
    mu, sd = F.avg("failure_rate").over(w), F.stddev_samp("failure_rate").over(w)
    # a spread below 1e-9 counts as none (no z-score from rounding noise)
    z = F.when(sd > 1e-9, (F.col("failure_rate") - mu) / sd)
    return (per.withColumn("z", z)
            # compared at 9 decimals so rounding noise cannot flip a z on the limit
            .withColumn("anomalous", F.coalesce(F.abs(F.round("z", 9)) > z_limit, F.lit(False))))


def metric_summary(long_rows: DataFrame, coarse: list[str] = (), run: str = "run_id") -> DataFrame:
    """Per run and metric: n, mean, min, max, sample stddev.  Metrics in
    ``coarse`` (large magnitudes) are rounded to 1 decimal, others to 6."""
    agg = long_rows.groupBy(run, "metric_name").agg(
        F.count("metric_value").alias("n"), F.avg("metric_value").alias("mean"),
        F.min("metric_value").alias("min"), F.max("metric_value").alias("max"),
        F.stddev_samp("metric_value").alias("stddev"))
    big = F.col("metric_name").isin(*coarse) if coarse else F.lit(False)
    return agg.select(run, "metric_name", "n",
                      *[F.when(big, F.round(c, 1)).otherwise(F.round(c, 6)).alias(c)
                        for c in ("mean", "min", "max", "stddev")])


def compare_runs(long: DataFrame, run_a, run_b, run: str = "run_id") -> DataFrame:
    """Two runs side by side per metric (full outer join), delta and
    relative delta (null when run a is 0)."""
    a = long.filter(F.col(run) == run_a).select("metric_name", F.col("metric_value").alias("run_a"))
    b = long.filter(F.col(run) == run_b).select("metric_name", F.col("metric_value").alias("run_b"))
    d = F.col("run_b") - F.col("run_a")
    return (a.join(b, "metric_name", "full")
            .select("metric_name", "run_a", "run_b", d.alias("delta"),
                    F.when(F.col("run_a") != 0, d / F.abs("run_a")).alias("relative_delta")))


def compare_many(long: DataFrame, runs: list, base, run: str = "run_id") -> DataFrame:
    """J3 over any number of runs: a row per metric with a column ``run_<id>`` for each of ``runs`` (the
    base among them or not), ``delta_<id>`` against the base and ``best``, the run with the highest value (the first
    in the list of equal ones).  One aggregate; a metric that a run lacks is null there."""
    wanted = [*runs, *([] if base in runs else [base])]
    at = lambda r: F.max(F.when(F.col(run).eqNullSafe(F.lit(r)), F.col("metric_value")))
    wide = long.filter(F.col(run).isin([r for r in wanted if r is not None]) | (F.col(run).isNull() if None in wanted else F.lit(False))) \
        .groupBy("metric_name").agg(*[at(r).alias(f"run_{r}") for r in wanted])
    ranked = F.array_max(F.filter(F.array(*[F.struct(F.col(f"run_{r}").alias("v"), F.lit(-i).alias("i"), F.lit(str(r)).alias("r")) for i, r in enumerate(wanted)]),
                                  lambda x: x["v"].isNotNull()))
    return wide.select("metric_name", *[f"run_{r}" for r in wanted], *[(F.col(f"run_{r}") - F.col(f"run_{base}")).alias(f"delta_{r}") for r in wanted if r != base],
                       ranked["r"].alias("best"))


def metric_trend(long: DataFrame, window: int = 3, run: str = "run_id", suite: str | None = None,
                 order: str | None = None) -> DataFrame:
    """Per suite (when given) and metric over its runs in time order
    (``order``, else the run's id): previous value and a rolling mean of the
    last ``window`` runs (over the run-level table, one row per run)."""
    suites = [suite] if suite else []
    w = Window.partitionBy(*suites, "metric_name").orderBy(*([order] if order else []), run)
    return long.select(
        *suites, run, *([order] if order else []), "metric_name", "metric_value",
        F.lag("metric_value").over(w).alias("previous_value"),
        F.round(F.avg("metric_value").over(w.rowsBetween(-(window - 1), 0)), 4).alias("rolling_mean"))


def dataset_growth(rows: DataFrame, dataset: str, ts: str, period: str = "day") -> DataFrame:
    """Rows added per dataset and period, with the running total.  The
    window runs over the aggregated (dataset, period) table."""
    per = rows.groupBy(dataset, F.date_trunc(period, ts).alias("period")).agg(
        F.count(F.lit(1)).alias("rows_added"))
    w = Window.partitionBy(dataset).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("cumulative_rows", F.sum("rows_added").over(w))
