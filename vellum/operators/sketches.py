"""Figures kept as mergeable sketches: run summaries for any range of days without reading rows (A8, A11),
column profiles over uploads without reading them again (A7, C6).

A KLL sketch answers quantiles with a bounded rank error, a theta sketch distinct counts, unions and
intersections with a bounded relative one (exact up to ``2 ** lg_entries`` distinct values).  Counts, sums, least and
greatest values are kept beside them and stay exact.  All of it merges with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.runs import FAILED_STATUS

# KLL's k: a rank error of about 0.7 % (1.3 % for a range) with 99 % confidence.
KLL_K = 400
QUANTILES = (0.5, 0.95, 0.99)
# Theta sketches keep 2 ** this many hashes: a relative error of about 0.8 % (one standard deviation).
LG_ENTRIES = 14


# ------------------------------------------------------------- runs by day

def day_figures(outputs: DataFrame, run: str = "run_id", ts: str = "ts", value: str = "response_time_ms", period: str = "day", k: int = KLL_K) -> DataFrame:
    """A row per run and period: rows, failures, sum, sum of squares, least, greatest and the sketch of the values."""
    v = F.col(value).cast("double")
    return outputs.groupBy(run, F.date_trunc(period, ts).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status_code") >= FAILED_STATUS).alias("failed"), F.count(v).alias("n_values"),
        F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def range_summary(figures: DataFrame, first=None, last=None, run: str = "run_id", quantiles: tuple = QUANTILES, k: int = KLL_K) -> DataFrame:
    """Per run over the periods from ``first`` to before ``last`` (all by default): rows, failed, error rate,
    mean, sample deviation, least, greatest and a column ``p..`` for each quantile.  Reads figures only."""
    if first is not None:
        figures = figures.filter(F.col("period") >= F.lit(first).cast(figures.schema["period"].dataType))
    if last is not None:
        figures = figures.filter(F.col("period") < F.lit(last).cast(figures.schema["period"].dataType))
    sums = figures.groupBy(run).agg(*[F.sum(c).alias(c) for c in ("rows", "failed", "n_values", "total", "squares")], F.min("least").alias("least"),
                                    F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    n = F.col("n_values")
    spread = F.when(n > 1, F.sqrt(F.greatest((F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1), F.lit(0.0))))
    at = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"p{100 * q:g}".replace(".", "_")) for q in quantiles]
    return sums.select(run, "rows", "failed", (F.col("failed") / F.col("rows")).alias("error_rate"), F.when(n > 0, F.col("total") / n).alias("mean"),
                       spread.alias("stddev"), "least", "greatest", *at)


def rank_errors(rows: DataFrame, summary: DataFrame, quantile: float, column: str, run: str = "run_id", value: str = "response_time_ms") -> DataFrame:
    """Per run, how far the quantile's true rank among the rows lies from the share asked for (0: within
    the ranks that equal values hold)."""
    known = summary.select(F.col(run).alias("_run"), F.col(column).alias("_at"))
    v = F.col(value).cast("double")
    met = rows.filter(v.isNotNull()).join(known, F.col(run).eqNullSafe(F.col("_run")))
    ranks = met.groupBy(run).agg(F.avg((v < F.col("_at")).cast("double")).alias("below"), F.avg((v <= F.col("_at")).cast("double")).alias("upto"))
    return ranks.select(run, F.greatest(F.col("below") - quantile, F.lit(quantile) - F.col("upto"), F.lit(0.0)).alias("rank_error"))


# ------------------------------------------------------------- columns by upload

def upload_profiles(df: DataFrame, upload: str = "upload", columns: list[str] | None = None, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """A row per upload and column: rows, non-null values, least and greatest (as text, by the column's own order)
    and the theta sketch of the values.  One aggregate over all columns, then a row each."""
    columns = columns or [c for c in df.columns if c != upload]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).cast("string").alias(f"a{i}"), F.max(v).cast("string").alias(f"b{i}"),
                 F.theta_sketch_agg(v.cast("string"), lg_entries).alias(f"s{i}")]
    row = df.groupBy(upload).agg(*aggs)
    return row.select(upload, F.col("_rows").alias("rows"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"), F.col(f"a{i}").alias("least"),
                 F.col(f"b{i}").alias("greatest"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])))


def _count(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def merged_profile(profiles: DataFrame, numeric: list[str] = (), lg_entries: int = LG_ENTRIES) -> DataFrame:
    """A7 over any number of uploads: one row a column, from the uploads' rows alone.  ``numeric`` columns compare
    as numbers, others as text."""
    is_number = F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    low = F.when(F.max(is_number), F.min(F.when(is_number, F.col("least").try_cast("double"))).cast("string")).otherwise(F.min("least"))
    high = F.when(F.max(is_number), F.max(F.when(is_number, F.col("greatest").try_cast("double"))).cast("string")).otherwise(F.max("greatest"))
    return profiles.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), low.alias("least"), high.alias("greatest"),
                                               _count(F.theta_union_agg("sketch", lg_entries)).alias("distinct_values"))


def value_overlap(profiles: DataFrame, version_a, version_b, upload: str = "upload") -> DataFrame:
    """Per column that both versions have: distinct values of each, of both together and in common, and
    the share of b's values that a has already (null for an empty b)."""
    side = lambda v, n: profiles.filter(F.col(upload) == F.lit(v)).select("column_name", F.col("sketch").alias(n))
    met = side(version_a, "a").join(side(version_b, "b"), "column_name")
    common = _count(F.theta_intersection("a", "b"))
    return met.select("column_name", _count(F.col("a")).alias("values_a"), _count(F.col("b")).alias("values_b"),
                      _count(F.theta_union("a", "b")).alias("values_both"), common.alias("values_common"),
                      F.when(_count(F.col("b")) > 0, common / _count(F.col("b"))).alias("known_share"))
