"""Table functions for user metrics that return many rows, usable from SQL.

A metric is a pair of plain functions: ``partial(rows) -> states`` maps any subset of a group's rows to a small frame of
additive statistics by bin, ``finish(states) -> rows`` turns their sums into the result.  Two polymorphic table functions are
registered for it: ``{name}_states``, called ``PARTITION BY`` group and a salt, so a group with a third of all rows is many
calls, and ``{name}_rows``, called ``PARTITION BY`` group over the summed states.  ``analyze`` reads the argument table's schema, so
group columns keep their names and types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from vellum.session import ship_code

SALTS = 16
# Rows handed to ``partial`` at a time.
CHUNK = 10_000


def _states_function(partial: Callable[[pd.DataFrame], pd.DataFrame], group: list[str], values: list[str], states: T.StructType):
    class States:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            names = {f.name: f for f in rows.dataType.fields}
            missing = [c for c in (*group, *values, "salt") if c not in names]
            if missing:
                raise ValueError(f"the argument table lacks {missing}")
            return AnalyzeResult(T.StructType([*[T.StructField(g, names[g].dataType) for g in group], *states.fields]),
                                 partitionBy=[PartitioningColumn(c) for c in (*group, "salt")], orderBy=[OrderingColumn("salt")])

        def __init__(self):
            self.key, self.held, self.parts = None, [], []

        def _reduce(self) -> None:
            if self.held:
                self.parts.append(partial(pd.DataFrame(self.held, columns=values)))
                self.held = []

        def eval(self, row):
            self.key = [row[g] for g in group]
            self.held.append([row[v] for v in values])
            if len(self.held) >= CHUNK:
                self._reduce()

        def terminate(self):
            self._reduce()
            for part in self.parts:
                for values_ in part[states.names].itertuples(index=False):
                    yield (*self.key, *[x.item() if hasattr(x, "item") else x for x in values_])

    return udtf(States)


def _rows_function(finish: Callable[[pd.DataFrame], pd.DataFrame], group: list[str], states: T.StructType, result: T.StructType):
    class Rows:
        @staticmethod
        def analyze(sums: AnalyzeArgument) -> AnalyzeResult:
            names = {f.name: f for f in sums.dataType.fields}
            return AnalyzeResult(T.StructType([*[T.StructField(g, names[g].dataType) for g in group], *result.fields]),
                                 partitionBy=[PartitioningColumn(g) for g in group])

        def __init__(self):
            self.key, self.held = None, []

        def eval(self, row):
            self.key = [row[g] for g in group]
            self.held.append([row[n] for n in states.names])

        def terminate(self):
            made = finish(pd.DataFrame(self.held, columns=states.names))
            for values in made[result.names].itertuples(index=False):
                yield (*self.key, *[None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in values])

    return udtf(Rows)


class TableMetric:
    """A registered metric; ``over`` composes its two calls."""

    def __init__(self, spark: SparkSession, name: str, group: list[str], values: list[str], states: str, bins: list[str], result: str,
                 partial: Callable[[pd.DataFrame], pd.DataFrame], finish: Callable[[pd.DataFrame], pd.DataFrame]):
        ship_code(spark)
        self.spark, self.name, self.group, self.values = spark, name, list(group), list(values)
        self.states, self.bins, self.result = T.StructType.fromDDL(states), list(bins), T.StructType.fromDDL(result)
        spark.udtf.register(f"{name}_states", _states_function(partial, self.group, self.values, self.states))
        spark.udtf.register(f"{name}_rows", _rows_function(finish, self.group, self.states, self.result))

    def over(self, df: DataFrame, salts: int = SALTS) -> DataFrame:
        """The metric's rows for every group of ``df``."""
        salted = df.select(*self.group, *self.values, F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(salts)).alias("salt"))
        view = f"metric_{uuid.uuid4().hex}"
        salted.createOrReplaceTempView(view)
        try:
            states = self.spark.sql(f"select * from {self.name}_states(table({view}))")
        finally:
            self.spark.catalog.dropTempView(view)
        sums = [c for c in self.states.names if c not in self.bins]
        summed = states.groupBy(*self.group, *self.bins).agg(*[F.sum(c).alias(c) for c in sums]).select(*self.group, *self.states.names)
        summed.createOrReplaceTempView(view)
        try:
            return self.spark.sql(f"select * from {self.name}_rows(table({view}))")
        finally:
            self.spark.catalog.dropTempView(view)


def calibration(spark: SparkSession, group: list[str], label: str = "y_true", score: str = "score", bins: int = 10, name: str = "calibration") -> TableMetric:
    """How well scores from 0 to 1 tell the share of positives: by score bin the rows, the mean score and the share.
    Rows without label or score are left out."""
    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows.dropna()
        at = (known[score].astype(float).clip(0, 1) * bins).astype(int).clip(upper=bins - 1)
        per = pd.DataFrame({"bin": at, "n": 1, "scores": known[score].astype(float), "positives": known[label].astype(float)}).groupby("bin").sum()
        return per.reset_index().astype({"bin": "int64", "n": "int64"})

    def finish(sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values("bin")
        return pd.DataFrame({"bin": sums["bin"], "rows": sums["n"], "mean_score": sums["scores"] / sums["n"], "positive_share": sums["positives"] / sums["n"]})

    return TableMetric(spark, name, group, [label, score], "bin long, n long, scores double, positives double", ["bin"],
                       "bin long, rows long, mean_score double, positive_share double", partial, finish)
