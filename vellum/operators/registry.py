"""Registry analytics: reads, searches, paging, joins and statistics over the
dataset / suite / evaluation registries (each a DataFrame with at least
``id, name, description, created_at, is_deleted``).

Point lookups of the reference become set-at-a-time joins; the N+1 stats
queries become one conditional aggregate (a single pass with map-side
partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import scalar as S
from vellum.plans.prefix import prefix_sums

# Status enums of the registries (lower-case values).
SUITE_STATUSES = ["ready", "running", "failed"]
EVAL_STATUSES = ["pending", "running", "completed", "failed"]

# Paging bounds of dataset / suite listings.
PAGE_SIZE_MIN, PAGE_SIZE_MAX = 1, 100


# ---------------------------------------------------------------- P1 - P15

def live(df: DataFrame) -> DataFrame:
    """Drop soft-deleted rows."""
    return df.filter(~F.col("is_deleted"))


def get_by_id(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows of live ``df`` whose id is in ``keys`` (left-semi join)."""
    return live(df).join(keys.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def get_by_name(df: DataFrame, names: DataFrame, name_col: str = "name",
                strip_argument: bool = True) -> DataFrame:
    """Exact, case-sensitive name lookup; the argument is stripped for
    datasets and suites, taken as given for evaluations."""
    arg = S.strip(name_col) if strip_argument else F.col(name_col)
    wanted = names.select(arg.alias("name")).distinct()
    return live(df).join(wanted, "name", "left_semi")


def exists_by(df: DataFrame, keys: DataFrame, key: str, key_col: str | None = None) -> DataFrame:
    """One boolean per requested key (id or name) among live rows."""
    key_col = key_col or key
    present = live(df).select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    wanted = keys.select(F.col(key_col).alias(key)).distinct()
    return (wanted.join(present, wanted[key] == present["_k"], "left")
            .select(F.col(key), F.coalesce(F.col("_hit"), F.lit(False)).alias("exists")))


def keyword_filter(keyword: str | None) -> Column:
    """``name ILIKE %k% OR description ILIKE %k%`` (wildcards stay live)."""
    if not keyword:
        return F.lit(True)
    pat = f"%{keyword}%"
    # a null description must not hide a name hit: coalesce the OR
    return F.coalesce(S.ilike("name", pat), F.lit(False)) | F.coalesce(S.ilike("description", pat), F.lit(False))


def keyword_search(df: DataFrame, keyword: str | None, status: str | None = None) -> DataFrame:
    """P6 + P7: live rows matching the keyword and, when given, the status."""
    out = live(df).filter(keyword_filter(keyword))
    if status:
        out = out.filter(F.col("status") == status)
    return out


def search_conjunctive(df: DataFrame, name: str | None = None, description: str | None = None,
                       suite_id=None, dataset_id=None, status: str | None = None,
                       metadata_col: str | None = None, metadata_key: str | None = None,
                       metadata_value: str | None = None, metadata_match: str = "equals") -> DataFrame:
    """AND of the optional filters; absent / blank ones are skipped.

    A metadata key with a value filters on it (``equals`` for datasets,
    ``contains`` for suites and evaluations); a key alone keeps rows that
    have the key (P9-P11)."""
    out = live(df)
    if metadata_col and metadata_key:
        if metadata_value:
            out = (metadata_equals if metadata_match == "equals" else metadata_contains)(
                out, metadata_col, metadata_key, metadata_value)
        else:
            out = metadata_has_key(out, metadata_col, metadata_key)
    if name and name.strip():
        out = out.filter(S.ilike("name", f"%{name.strip()}%"))
    if description and description.strip():
        out = out.filter(S.ilike("description", f"%{description.strip()}%"))
    if suite_id is not None:
        out = out.filter(F.col("suite_id") == F.lit(suite_id))
    if dataset_id is not None:
        out = out.filter(F.col("dataset_id") == F.lit(dataset_id))
    if status:
        out = out.filter(F.col("status") == status)
    return out


def metadata_equals(df: DataFrame, meta_col: str, key: str, value: str) -> DataFrame:
    """``metadata->>key = value`` (exact text)."""
    return df.filter(S.json_text(meta_col, key) == F.lit(value))


def metadata_contains(df: DataFrame, meta_col: str, key: str, value: str) -> DataFrame:
    """P10: ``metadata->>key ILIKE %value%``."""
    return df.filter(S.ilike(S.json_text(meta_col, key), f"%{value}%"))


def metadata_has_key(df: DataFrame, meta_col: str, key: str) -> DataFrame:
    """Top-level key present (a JSON null value counts)."""
    return df.filter(F.coalesce(S.json_has_key(meta_col, key), F.lit(False)))


def newest_first(*extra: str) -> list[Column]:
    """Registry listing order: created_at DESC with nulls first (PostgreSQL
    semantics), then id as a stable tie-break of ours."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()] + [F.col(e) for e in extra]


def by_foreign_key(df: DataFrame, fk: str) -> DataFrame:
    """Children of every parent, newest first, with the per-parent count.

    Position and count come from the two-phase prefix sum over (parent,
    created_at desc nulls first, id): a parent holding a third of all
    children is spread over many tasks instead of one window partition.
    """
    rows = live(df).filter(F.col(fk).isNotNull())
    ts = F.col("created_at")
    if dict(rows.dtypes)["created_at"] == "timestamp_ntz":
        # micros since the epoch on the wall clock: no session time zone involved
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    else:
        micros = F.unix_micros(ts)
    # Only keys and order are written and ranked; the rows join their position by id.
    keyed = rows.select(F.col(fk).alias("_parent"), F.col("id").alias("_id"), ts.isNotNull().cast("int").alias("_has_ts"),
                        F.coalesce(-micros, F.lit(0)).alias("_neg_ts"))
    ranked = prefix_sums(keyed, ["_has_ts", "_neg_ts", "_id"], [], group_cols=["_parent"])
    places = ranked.select("_id", F.col("rows_cum").alias("position"), F.col("rows_total").alias("n_children"))
    return rows.join(places, F.col("id") == F.col("_id")).drop("_id")


def to_record(df: DataFrame, kind: str) -> DataFrame:
    """The client projection: ids as text, status lower-case (default when
    null), timestamps ISO-8601, metadata ``{}`` when null."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if name == "id" or name.endswith("_id"):
            c = c.cast("string")
        elif name == "status":
            default = "ready" if kind == "suite" else "pending"
            c = F.coalesce(F.lower(c), F.lit(default))
        elif dtype.startswith("timestamp"):
            c = S.isoformat(c)
        elif name.endswith("metadata"):
            c = F.coalesce(c, F.lit("{}"))
        cols.append(c.alias(name))
    return df.select(*cols)


def normalise_args(df: DataFrame, col: str) -> DataFrame:
    """Strip each argument; blank becomes absent (null)."""
    return df.withColumn(col, S.blank_to_null(col))


def row_search(df: DataFrame, keyword: str) -> DataFrame:
    """Rows where any string column contains ``keyword`` (ILIKE)."""
    pat = f"%{keyword}%"
    conds = [F.coalesce(S.ilike(n, pat), F.lit(False)) for n, t in df.dtypes if t == "string"]
    if not conds:
        return df.limit(0)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return df.filter(cond)


# ---------------------------------------------------------------- L1 - L4

def page_args(page: int, page_size: int, clamp: bool) -> tuple[int, int]:
    """Datasets and suites clamp the arguments; evaluations reject them."""
    if clamp:
        return max(1, page), min(PAGE_SIZE_MAX, max(PAGE_SIZE_MIN, page_size))
    if page < 1 or not (PAGE_SIZE_MIN <= page_size <= PAGE_SIZE_MAX):
        raise ValueError(f"invalid paging arguments page={page} page_size={page_size}")
    return page, page_size


def paginate(df: DataFrame, page: int, page_size: int, clamp: bool = True) -> DataFrame:
    """L1: one page of live rows, newest first, with the paging figures.

    ``orderBy(...).offset(o).limit(n)`` plans as a take-ordered of o+n rows
    per partition (no full sort); the total is a scalar subquery.
    """
    page, page_size = page_args(page, page_size, clamp)
    rows = live(df)
    total = rows.agg(F.count(F.lit(1))).scalar()
    pg = (rows.orderBy(*newest_first()).offset((page - 1) * page_size).limit(page_size))
    total_pages = S.ceil_div("total_count", page_size)
    return (pg.withColumn("total_count", total)
            .withColumn("page", F.lit(page))
            .withColumn("page_size", F.lit(page_size))
            .withColumn("total_pages", total_pages)
            .withColumn("has_next", F.lit(page) < total_pages)
            .withColumn("has_prev", F.lit(page > 1)))


def page_after(df: DataFrame, created_at, last_id, page_size: int, clamp: bool = True) -> DataFrame:
    """L1 for deep pages: the page that follows the row (``created_at``,
    ``last_id``) in listing order.  The rows before it are filtered away, so any page
    costs a take-ordered of one page, however deep it lies."""
    _, page_size = page_args(1, page_size, clamp)
    ts, at = F.col("created_at"), F.lit(created_at)
    if created_at is None:  # nulls come first: the rest of them, then everything else
        behind = (ts.isNull() & (F.col("id") > F.lit(last_id))) | ts.isNotNull()
    else:
        behind = (ts < at) | ((ts == at) & (F.col("id") > F.lit(last_id)))
    return live(df).filter(behind).orderBy(*newest_first()).limit(page_size)


def recent_n(df: DataFrame, n: int = 5) -> DataFrame:
    """L3: the n newest live rows (TakeOrderedAndProject, no full sort)."""
    return live(df).orderBy(*newest_first()).limit(n)


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """L4: live rows sorted by any column (range-partitioned global sort).
    Nulls sort as the largest value, as in PostgreSQL and ``newest_first``."""
    c = F.col(column)
    return live(df).orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("id"))


# ---------------------------------------------------------------- J1 - J2

def suite_frozen(suites: DataFrame, evals: DataFrame) -> DataFrame:
    """A suite with at least one live evaluation has a frozen config.

    Evaluations are pre-aggregated per suite before the join, so the join
    input on that side is one row per suite whatever the skew of evals.
    """
    n = live(evals).groupBy(F.col("suite_id").alias("id")).agg(F.count(F.lit(1)).alias("n_live_evals"))
    return (live(suites).select("id", "name").join(n, "id", "left")
            .select("id", "name", F.coalesce("n_live_evals", F.lit(0)).alias("n_live_evals"),
                    (F.coalesce("n_live_evals", F.lit(0)) > 0).alias("frozen")))


def suite_with_dataset(suites: DataFrame, datasets: DataFrame) -> DataFrame:
    """Suite detail with the name of its dataset; a deleted or missing
    dataset leaves it null.  The planner broadcasts the dataset side by its
    bytes; AQE splits a hot dataset's suites otherwise."""
    ds = live(datasets).select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return live(suites).select("id", "name", "dataset_id").join(ds, "dataset_id", "left")


# ---------------------------------------------------------------- A2 - A6

def dataset_stats(datasets: DataFrame) -> DataFrame:
    """A2: n, sum(total_rows) (null -> 0), average = sum / n (0 when n = 0)."""
    d = live(datasets)
    return d.agg(F.count(F.lit(1)).alias("total_datasets"),
                 F.coalesce(F.sum("total_rows"), F.lit(0)).cast("bigint").alias("total_rows")) \
        .select("total_datasets", "total_rows",
                F.when(F.col("total_datasets") > 0, F.col("total_rows") / F.col("total_datasets"))
                .otherwise(F.lit(0.0)).alias("average_rows_per_dataset"))


def suite_stats(suites: DataFrame) -> DataFrame:
    """A3: the eight suite figures in one pass."""
    s = live(suites)
    agg = s.agg(
        F.count(F.lit(1)).alias("total_suites"),
        F.count_if(F.col("dataset_id").isNotNull()).alias("suites_with_dataset"),
        F.count_if(F.col("status") == "ready").alias("total_ready"),
        F.count_if(F.col("status") == "running").alias("total_running"),
        F.count_if(F.col("status") == "failed").alias("total_failed"),
        F.coalesce(F.sum("total_evals"), F.lit(0)).cast("bigint").alias("total_evals"),
    )
    return agg.select(
        "total_suites", "suites_with_dataset",
        (F.col("total_suites") - F.col("suites_with_dataset")).alias("suites_without_dataset"),
        "total_ready", "total_running", "total_failed", "total_evals",
        F.when(F.col("total_suites") > 0, F.round(F.col("total_evals") / F.col("total_suites"), 2))
        .otherwise(F.lit(0.0)).alias("average_evals_per_suite"))


def _eval_stat_columns() -> list[Column]:
    dur = S.epoch_seconds_between("started_at", "completed_at")
    done = (F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    return [F.count(F.lit(1)).alias("total_evaluations")] + \
        [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in EVAL_STATUSES] + [
        F.coalesce(F.sum("total_requests"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("successful_requests"), F.lit(0)).cast("bigint").alias("successful_requests"),
        F.coalesce(F.sum("failed_requests"), F.lit(0)).cast("bigint").alias("failed_requests"),
        F.avg("total_requests").alias("_avg_req"),
        F.avg(F.when(done, dur)).alias("_avg_dur"),
    ]


def _eval_stat_finish(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "total_evaluations", *[f"n_{s}" for s in EVAL_STATUSES],
        "total_requests", "successful_requests", "failed_requests",
        F.round(S.percent("successful_requests", "total_requests"), 2).alias("success_rate"),
        F.round(F.coalesce("_avg_req", F.lit(0.0)), 2).alias("average_requests_per_eval"),
        # a mean of exactly 0 is reported as 0 (the reference turns it into null)
        F.round("_avg_dur", 2).alias("average_completion_time_seconds"))


def eval_stats(evals: DataFrame) -> DataFrame:
    """A4: every evaluation figure from one aggregate."""
    return _eval_stat_finish(live(evals).agg(*_eval_stat_columns()), [])


def eval_stats_by_suite(evals: DataFrame) -> DataFrame:
    """A5: A4 for every suite at once (hash aggregate with partial combine)."""
    return _eval_stat_finish(live(evals).groupBy("suite_id").agg(*_eval_stat_columns()), ["suite_id"])


def total_rows_rollup(datasets: DataFrame, uploads: DataFrame) -> DataFrame:
    """total_rows = old + sum of accepted upload row counts, per dataset."""
    add = (uploads.filter(F.col("accepted")).groupBy("dataset_id")
           .agg(F.sum("row_count").alias("rows_added")))
    return (datasets.select("id", "total_rows")
            .join(add, datasets["id"] == add["dataset_id"], "left")
            .select("id", (F.coalesce("total_rows", F.lit(0)) + F.coalesce("rows_added", F.lit(0)))
                    .cast("bigint").alias("total_rows")))
