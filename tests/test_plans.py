"""Physical-plan checks: filters reach the Parquet scan, only the needed
columns are read, aggregates combine map-side, small sides broadcast."""

import contextlib
import io

import __spark_entry__ as E

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_filter_pushdown_and_pruning(spark, sf_small):
    p = plan(Q["parquet_scan"](spark, sf_small))
    assert "GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in p


def test_column_pruning_on_json_filter(spark, sf_small):
    p = plan(Q["metadata_equals"](spark, sf_small))
    assert "ReadSchema: struct<event_id:bigint,props:string>" in p


def test_stats_are_one_partial_aggregate(spark, sf_small):
    p = plan(Q["eval_stats_by_suite"](spark, sf_small))
    assert "partial_count" in p  # map-side combine before the shuffle


def test_small_dimension_is_broadcast(spark, sf_small):
    p = plan(Q["suite_with_dataset"](spark, sf_small))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_top_k_page_does_not_sort_everything(spark, sf_small):
    p = plan(Q["recent_n"](spark, sf_small))
    assert "TakeOrderedAndProject" in p


def jobs_before_the_action(spark, build) -> int:
    """Jobs that building a query starts by itself."""
    spark.sparkContext.setJobGroup("build", "build")
    build()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("build"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_no_eager_size_checks(spark, sf_small):
    from vellum.operators import registry as R
    from vellum.operators import validate as V
    from vellum.plans.fixtures import Fixtures

    fx = Fixtures(spark, sf_small)
    suites, evals, datasets = fx.reg_suites, fx.reg_evals, fx.reg_datasets
    assert jobs_before_the_action(spark, lambda: R.suite_with_dataset(suites, datasets)) == 0
    assert jobs_before_the_action(spark, lambda: V.check_references(evals, "suite_id", suites, "suite")) == 0
    assert jobs_before_the_action(spark, lambda: V.check_unique_name(suites)) == 0


def test_counts_are_checked_in_one_scan(spark, sf_small):
    from vellum.operators import validate as V

    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    p = plan(V.check_counts(orders, ["o_custkey", "o_totalprice", "o_orderstatus"], "o_orderkey"))
    assert p.count("Scan parquet") == 2  # once in the tree, once in its details


def test_text_metrics_shuffle_no_grams(spark):
    from vellum.functions import metrics as M

    df = spark.createDataFrame([("a b c", "a b d")], "reference string, output string")
    assert plan(M.bleu(df)).count("Exchange SinglePartition") + plan(M.bleu(df)).count("Exchange (") <= 3
    assert "SortMergeJoin" not in plan(M.bleu(df)) and "BroadcastHashJoin" not in plan(M.bleu(df))


def test_path_expression_grows_with_its_length(spark):
    from vellum.operators import pipeline as P

    df = spark.createDataFrame([("{}",)], "r string")
    size = lambda n: len(P.postprocess_path(df, "r", ["0"] * n)._jdf.queryExecution().analyzed().toString())
    assert size(8) < 3 * size(4)


def test_deep_page_takes_one_page(spark, sf_small):
    import datetime as dt

    from vellum.operators import registry as R
    from vellum.plans.fixtures import Fixtures

    p = plan(R.page_after(Fixtures(spark, sf_small).reg_suites, dt.datetime(1995, 1, 1), 5, 20))
    assert "TakeOrderedAndProject" in p
