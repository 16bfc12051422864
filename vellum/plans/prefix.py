"""Running sums over a global (or per-group) order without a single-task window.

``Window.orderBy(x)`` with no partition -- or a partition holding a third of
the rows -- sorts everything in one task.  The two-phase prefix sum below
keeps every task bounded and stays in the JVM:

1. range-partition the rows on (group, order) -- a hot group is spread over
   many partitions because the range cut continues inside the group -- and
   write them once with their partition number, because the boundaries are
   sampled at run time;
2. a window per (partition number, group) gives the local running sums;
3. the per-(partition, group) totals -- at most partitions + groups rows --
   get an exclusive running sum over the partition number per group;
4. those offsets are joined back on (partition, group), nulls matching nulls.

Sums keep Spark's own types (bigint for integers, decimal for decimals), so
integers stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import saved


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                group_cols: list[str] | tuple = (), num_partitions: int | None = None) -> DataFrame:
    """Add, for each value column, ``<v>_cum`` (inclusive running sum in
    (group, order) row order) and ``<v>_total`` (sum over the group), and for
    the rows ``rows_cum`` (the row number) and ``rows_total``.

    Order columns sort ascending, nulls first; negate a column first for a
    descending order.  A null group key is a group of its own, a null value
    counts as 0.  Equal order keys keep an arbitrary but fixed order.
    """
    group_cols, order_cols, value_cols = list(group_cols), list(order_cols), list(value_cols)
    keys = group_cols + order_cols
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id()), "prefix")

    here = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"{v}_lcum": F.sum(F.coalesce(v, F.lit(0))).over(here) for v in value_cols}
                              | {"rows_lcum": F.count(F.lit(1)).over(here)})

    sums = {f"{v}_tot": F.sum(F.coalesce(v, F.lit(0))) for v in value_cols} | {"rows_tot": F.count(F.lit(1))}
    tot = dealt.groupBy("_pid", *group_cols).agg(*[c.alias(n) for n, c in sums.items()])
    before = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    names = [*value_cols, "rows"]
    offs = tot.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_o_{g}") for g in group_cols],
                      *[F.coalesce(F.sum(f"{v}_tot").over(before), F.lit(0)).alias(f"{v}_off") for v in names],
                      *[F.sum(f"{v}_tot").over(whole).alias(f"{v}_total") for v in names])
    match = F.col("_pid") == F.col("_opid")
    for g in group_cols:
        match = match & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return local.join(offs, match).select(
        *df.columns,
        *[(F.col(f"{v}_lcum") + F.col(f"{v}_off")).alias(f"{v}_cum") for v in names],
        *[f"{v}_total" for v in names])


def exact_quantile(df: DataFrame, group_cols: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact continuous quantile per group (linear interpolation between the
    values at positions floor(h) and ceil(h), h = q * (n - 1)) -- the
    definition of ``percentile`` / ``quantile_cont`` -- without buffering a
    whole group in one task.

    Equal values are counted first (map-side combine), so a value that fills
    half a group is one row; the running sum of the counts gives each value's
    positions.  Null values are ignored; a null group is a group.
    """
    group_cols = list(group_cols)
    counts = (df.select(*group_cols, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c")))
    h = F.lit(q) * (F.col("_c_total") - 1)
    first, last = F.col("_c_cum") - F.col("_c"), F.col("_c_cum") - 1
    at = lambda pos: F.max(F.when((pos >= first) & (pos <= last), F.col("_v")))
    agg = prefix_sums(counts, ["_v"], ["_c"], group_cols=group_cols).groupBy(*group_cols).agg(
        at(F.floor(h)).alias("_a"), at(F.ceil(h)).alias("_b"), F.max(h - F.floor(h)).alias("_f"))
    return agg.select(*group_cols, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))
