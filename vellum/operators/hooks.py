"""User code hooks (H1-H5): the Python slow path, batched through Arrow.

Callers pass plain Python functions; Spark partitions the rows and runs the
functions inside tasks on Arrow batches.  Nothing is collected to the driver
and no group is buffered whole: the group metric hook takes mergeable
partial states (sufficient statistics) instead of a whole run.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def preprocess_hook(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """H1: a user preprocessing function applied to every Arrow batch."""
    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


SCORE_FIELDS = [
    T.StructField("response", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
]


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame, int], pd.DataFrame],
                  batch_size: int = 100, workers: int | None = None, max_attempts: int = 3,
                  retry_on: tuple[str, ...] = ("timeout", "rate_limit"), base_delay: float = 0.0,
                  max_delay: float = 60.0) -> DataFrame:
    """H2 + H3: the invocation step as a batched scorer with retries.

    ``scorer(chunk, attempt)`` gets up to ``batch_size`` rows and returns a
    frame with ``response`` and ``error`` (None when fine) in the same order.
    Rows whose error is in ``retry_on`` -- a kind by its name, or a family of
    status codes such as ``5xx`` -- are retried with exponential back-off
    (``base_delay * 2**(attempt-1)`` seconds, at most ``max_delay``) up to
    ``max_attempts``; the rest end as dead letters.  ``workers`` spreads the
    rows round-robin over that many tasks (the concurrency toward the
    scored service).
    """
    if not 1 <= batch_size <= 1000:
        raise ValueError("batch_size must be within 1..1000")
    src = df.repartition(workers) if workers else df
    kinds = {r for r in retry_on if not re.fullmatch(r"[1-5]xx", r)}
    families = "".join(r[0] for r in retry_on if r not in kinds)
    family = re.compile(rf"(?<![0-9])[{families}][0-9][0-9](?![0-9])") if families else None

    def retried(error: str) -> bool:
        return error in kinds or bool(family and family.search(error))

    schema = T.StructType(list(df.schema.fields) + SCORE_FIELDS)

    def call(chunk: pd.DataFrame, attempt: int) -> pd.DataFrame:
        try:
            res = scorer(chunk.reset_index(drop=True), attempt)
            return pd.DataFrame({"response": list(res["response"]), "error": list(res["error"])})
        except Exception as e:  # a failing call fails every row of the chunk
            return pd.DataFrame({"response": [None] * len(chunk), "error": [f"exception:{type(e).__name__}"] * len(chunk)})

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                resp = pd.Series([None] * len(chunk), dtype=object)
                err = pd.Series([None] * len(chunk), dtype=object)
                attempts = pd.Series([0] * len(chunk), dtype="int32")
                todo = list(range(len(chunk)))
                attempt = 0
                while todo and attempt < max_attempts:
                    attempt += 1
                    if attempt > 1 and base_delay > 0:
                        time.sleep(min(max_delay, base_delay * 2 ** (attempt - 2)))
                    got = call(chunk.iloc[todo], attempt)
                    retry = []
                    for j, i in enumerate(todo):
                        attempts[i] = attempt
                        e = got["error"][j]
                        resp[i], err[i] = got["response"][j], e
                        if e is not None and retried(str(e)):
                            retry.append(i)
                    todo = retry
                out = chunk.copy()
                out["response"] = resp
                out["error"] = err
                out["attempts"] = attempts
                out["status"] = ["ok" if e is None else "dead_letter" for e in err]
                yield out

    return src.mapInPandas(run, schema)


def split_dead_letters(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H3: (outputs, dead letters)."""
    return scored.filter(F.col("status") == "ok"), scored.filter(F.col("status") != "ok")


def row_metric_hook(fn: Callable[..., pd.Series]):
    """H4: wrap a user row metric ``fn(*series) -> series of float`` as an
    Arrow-batched pandas UDF returning double."""
    return F.pandas_udf(fn, "double")


def group_metric_hook(df: DataFrame, group: list[str], value_cols: list[str],
                      partial: Callable[[pd.DataFrame], list[float]],
                      finish: Callable[[list[float]], float], n_stats: int) -> DataFrame:
    """H5: a user metric over whole runs, as a mergeable aggregate.

    ``partial(rows)`` maps any subset of a run to ``n_stats`` additive
    statistics; the statistics of all subsets are summed per run by Spark
    (map-side combined), then ``finish(stats)`` gives the metric.  A run of
    any size is never held in one task.
    """
    group = list(group)
    state_schema = T.StructType([df.schema[g] for g in group] +
                                [T.StructField("stats", T.ArrayType(T.DoubleType()), False)])

    def partials(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby(group, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                st = [float(x) for x in partial(part[value_cols])]
                if len(st) != n_stats:
                    raise ValueError("partial() returned the wrong number of statistics")
                rows.append((*key, st))
            yield pd.DataFrame(rows, columns=group + ["stats"])

    states = df.select(*group, *value_cols).mapInPandas(partials, state_schema)
    summed = (states.select(*group, F.posexplode("stats").alias("i", "x"))
              .groupBy(*group, "i").agg(F.sum("x").alias("x"))
              .groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")))

    @F.pandas_udf("double")
    def finish_udf(s: pd.Series) -> pd.Series:
        return s.apply(lambda arr: float(finish([e["x"] for e in arr])))

    return summed.select(*group, finish_udf("s").alias("metric_value"))
