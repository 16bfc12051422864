"""All registered queries: name -> (fixtures -> DataFrame), plus their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans.fixtures import Fixtures

_MODULES = [
    "vellum.plans.registry_queries",
    "vellum.plans.check_queries",
    "vellum.plans.metric_queries",
    "vellum.plans.run_queries",
    "vellum.plans.pipeline_queries",
    "vellum.plans.config_queries",
    "vellum.plans.ingest_queries",
    "vellum.plans.stream_queries",
    "vellum.plans.index_queries",
]


def _load():
    qs: dict = {}
    os_: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        for k in mod.Q:
            if k in qs:
                raise ValueError(f"duplicate query {k}")
        qs.update(mod.Q)
        os_.update(mod.O)
    return qs, os_


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    qs, _ = _load()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = fn.__name__
        return run

    return {k: bind(fn) for k, fn in qs.items()}


def oracle_texts() -> dict[str, str]:
    return dict(_load()[1])
