"""Hand-made edge cases: nulls, ties, zero denominators, wildcards, dotted
JSON keys, hot groups, replay rules, retries, drift, corrupt files."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from vellum.functions import metrics as M
from vellum.functions import scalar as S
from vellum.operators import config as K
from vellum.operators import hooks as H
from vellum.operators import pipeline as P
from vellum.operators import registry as R
from vellum.operators import schema as C
from vellum.operators import validate as V
from vellum.plans.prefix import exact_quantile, prefix_sums


# ------------------------------------------------------------- prefix sums

def test_prefix_sums_match_window_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 50, n))  # group 0 holds a third
    pdf = pd.DataFrame({"g": g.astype("int64"), "o": rng.permutation(n).astype("int64"),
                        "v": rng.integers(0, 10, n).astype("int64")})
    df = spark.createDataFrame(pdf)
    got = prefix_sums(df, ["o"], ["v"], group_cols=["g"], num_partitions=16).toPandas()
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "o", F.sum("v").over(w).alias("want"), F.row_number().over(Window.partitionBy("g").orderBy("o")).alias("rn")).toPandas()
    m = got.merge(want, on=["g", "o"])
    assert len(m) == n
    assert (m["v_cum"] == m["want"]).all()
    assert (m["rows_cum"] == m["rn"]).all()


def test_prefix_sums_global(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") % 3).alias("v"))
    got = prefix_sums(df, ["o"], ["v"], num_partitions=7).orderBy("o").toPandas()
    assert (got["v_cum"].to_numpy() == np.cumsum(np.arange(1000) % 3)).all()


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 500).astype("int64"), "x": rng.normal(size=500)})
    got = {r["k"]: r["q"] for r in exact_quantile(spark.createDataFrame(pdf), ["k"], "x", 0.95, "q").collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.percentile(part["x"], 95), rel=1e-12)


# ------------------------------------------------------------- scalar functions

def test_strip_takes_python_whitespace(spark):
    s = "\u2003 name \t\u3000\x1c"
    got = spark.createDataFrame([(s,)], "x string").select(S.strip("x").alias("y")).first()["y"]
    assert got == s.strip()


def test_isoformat_drops_zero_fraction(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.000123' b")
    r = df.select(S.isoformat("a").alias("a"), S.isoformat("b").alias("b")).first()
    assert (r["a"], r["b"]) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000123")


def test_parse_stamp_keeps_raw_text(spark):
    df = spark.createDataFrame([("20240105_101112",), ("manual-import",), ("20241399_000000",)], "s string")
    got = [r["p"] for r in df.select(S.parse_upload_stamp("s").alias("p")).collect()]
    assert got == ["2024-01-05T10:11:12", "manual-import", "20241399_000000"]


def test_format_bytes(spark):
    df = spark.createDataFrame([(0.0,), (1023.0,), (1024.0,), (1536.0,), (1048576 * 3.257,)], "b double")
    got = [r["s"] for r in df.select(S.format_bytes("b").alias("s")).collect()]
    assert got == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "3.26 MB"]


# ------------------------------------------------------------- registry / search

REG = "id int, name string, description string, created_at timestamp_ntz, is_deleted boolean, metadata string"


def _reg(spark):
    rows = [
        (1, "alpha_1", None, None, False, '{"a": {"b": 1}, "x.y": "q", "n": null, "t": true}'),
        (2, "beta%2", "the 100% set", None, False, "{}"),
        (3, "gamma", "Alpha again", None, True, "[]"),
        (4, "delta", "axb", None, False, "not json"),
        (5, "eps", None, None, False, None),
    ]
    return spark.createDataFrame(rows, REG)


def test_keyword_null_description_and_live_wildcards(spark):
    df = _reg(spark)
    assert {r["id"] for r in R.keyword_search(df, "alpha").collect()} == {1}  # 3 is deleted
    assert {r["id"] for r in R.keyword_search(df, "a_b").collect()} == {4}    # '_' is a wildcard
    assert {r["id"] for r in R.keyword_search(df, "0%").collect()} == {2}


def test_metadata_dotted_keys_nested_and_null(spark):
    df = _reg(spark)
    assert [r["id"] for r in R.metadata_equals(df, "metadata", "x.y", "q").collect()] == [1]
    assert [r["id"] for r in R.metadata_equals(df, "metadata", "a", '{"b":1}').collect()] == [1]
    assert [r["id"] for r in R.metadata_equals(df, "metadata", "t", "true").collect()] == [1]
    assert [r["id"] for r in R.metadata_has_key(df, "metadata", "n").collect()] == [1]
    assert R.metadata_has_key(df, "metadata", "zz").count() == 0


def test_eval_paging_rejects_bad_arguments(spark):
    with pytest.raises(ValueError):
        R.paginate(_reg(spark), page=0, page_size=10, clamp=False)
    rows = R.paginate(_reg(spark), page=0, page_size=1000, clamp=True).collect()
    assert rows[0]["page"] == 1 and rows[0]["page_size"] == 100


def test_nulls_first_newest_first(spark):
    rows = [(1, "a", None, None, False, None), (2, "b", None, None, False, None)]
    df = spark.createDataFrame(rows, REG).withColumn(
        "created_at", F.when(F.col("id") == 2, F.lit("2024-01-01").cast("timestamp_ntz")))
    assert [r["id"] for r in R.recent_n(df, 5).collect()] == [1, 2]


# ------------------------------------------------------------- validation

def test_name_rules_unicode_space_and_limits(spark):
    rows = [(1, "ok name"), (2, "with nbsp"), (3, "   "), (4, None), (5, "x" * 256), (6, "bad#"), (7, "")]
    df = spark.createDataFrame(rows, "id int, name string")
    got = {r["id"]: r["rule"] for r in V.check_name(df).collect()}
    assert got == {3: "name_blank", 4: "name_missing", 5: "name_too_long", 6: "name_invalid_chars", 7: "name_missing"}


def test_metadata_rules(spark):
    df = _reg(spark)
    got = {r["id"]: r["rule"] for r in V.check_metadata(df, "id", "metadata").collect()}
    assert got == {3: "metadata_not_object", 4: "metadata_not_json"}


def test_uuid_forms(spark):
    u = "12345678-1234-5678-1234-567812345678"
    rows = [(1, u), (2, u.replace("-", "")), (3, "{" + u.upper() + "}"), (4, "urn:uuid:" + u), (5, u[:-1]), (6, u + "0")]
    got = {r["id"] for r in V.check_uuid(spark.createDataFrame(rows, "id int, u string"), "id", "u").collect()}
    assert got == {5, 6}


def test_unique_names_among_live(spark):
    rows = [(1, "a", False), (2, "a", False), (3, "b", False), (4, "b", True), (5, "c", False)]
    df = spark.createDataFrame(rows, "id int, name string, is_deleted boolean")
    assert {r["id"] for r in V.check_unique_name(df).collect()} == {1, 2}


# ------------------------------------------------------------- pipeline

def test_extract_path_index_key_and_errors(spark):
    rows = [(1, '{"c": [{"t": "x"}]}'), (2, '{"c": {"0": {"t": "y"}}}'), (3, '{"c": []}'),
            (4, '{"c": 5}'), (5, '{"d": 1}'), (6, "not json")]
    df = spark.createDataFrame(rows, "id int, r string")
    got = {r["id"]: (r["output"], r["error_message"]) for r in P.postprocess_path(df, "r", ["c", "0", "t"], ["id"]).collect()}
    assert got[1] == ("x", None) and got[2] == ("y", None)
    assert got[3][0] is None and "no element" in got[3][1]
    assert got[4][0] is None and "no step" in got[4][1]
    assert got[5][0] is None and "no key" in got[5][1]
    assert got[6][0] is None and "valid JSON" in got[6][1]
    one = P.postprocess_path(spark.createDataFrame([(1, '{"message": "hi"}')], "id int, r string"), "r", "message", ["id"])
    assert one.first()["output"] == "hi"


def test_preprocess_checks_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, q string, y double")
    with pytest.raises(P.PipelineError):
        P.preprocess_select(df, ["nope"], "y")
    r = P.preprocess_select(df, [], None).first()
    assert r["groundtruth"] is None and r["input"]["q"] == "a"


def test_metric_dispatch_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0)], "id int, o double, t double")
    got = {r["metric_name"]: r["metric_value"] for r in P.metric_dispatch(df, "o", "t", ["abs_error", "bogus"], ["id"]).collect()}
    assert got == {"abs_error": 2.0}
    assert P.metric_dispatch(df, "o", "t", ["bogus"], ["id"]).count() == 0


# ------------------------------------------------------------- metrics

def test_cosine_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(M.cosine_similarity("a", "b").alias("c")).collect()]
    assert got == [0.0, 1.0]


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y_true int, score double")
    assert M.auc_roc(df).first()["auc"] == pytest.approx((1 + 1 + 0.5 + 1) / 4)


def test_report_zero_division(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "y_true string, y_pred string")
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep["a"]["precision"] == 0.0 and rep["b"]["recall"] == 0.0 and rep["micro avg"]["f1"] == 0.0


def test_r2_can_be_negative(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, -1.0), (3.0, 0.0)], "y_true double, y_pred double")
    assert M.regression_metrics(df).first()["r2"] < 0


def test_bleu_identical_is_one(spark):
    t = "the cat sat on the mat today"
    df = spark.createDataFrame([(1, t, t)], "k int, reference string, output string")
    assert M.bleu(df, ["k"]).first()["bleu"] == pytest.approx(1.0)


def test_mrr_and_map_without_relevant(spark):
    rows = [(1, 10, 0.9, 0), (1, 11, 0.8, 2), (2, 20, 0.5, 0)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double, grade int")
    rr = {r["query_id"]: r["rr"] for r in M.reciprocal_rank_per_query(df).collect()}
    ap = {r["query_id"]: r["ap"] for r in M.average_precision_per_query(df).collect()}
    assert rr == {1: 0.5, 2: 0.0} and ap == {1: 0.5, 2: 0.0}


def test_confusion_matrix_zero_fill(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y_true string, y_pred string")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df, labels=["a", "b"]).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}
    assert M.confusion_matrix(df).count() == 2  # the pairs that occur


# ------------------------------------------------------------- replay

def test_config_replay_rules(spark):
    log = spark.createDataFrame([(1, 1, "save", 0), (1, 2, "save", 0), (1, 3, "rollback", 5), (1, 4, "rollback", 1),
                                 (1, 5, "save", 0), (2, 1, "rollback", 0)], "suite_id int, seq int, op string, target int")
    rep = {r["seq"] if r["suite_id"] == 1 else -1: r for r in K.replay_config_log(log).collect()}
    assert [rep[s]["latest_version"] for s in (1, 2, 3, 4, 5)] == [1, 2, 2, 2, 3]
    assert [rep[s]["valid"] for s in (1, 2, 3, 4, 5)] == [True, True, False, True, True]
    assert [rep[s]["current_version"] for s in (1, 2, 3, 4, 5)] == [1, 2, 2, 1, 3]
    assert rep[4]["previous_version"] == 2
    assert rep[-1]["valid"] and rep[-1]["current_version"] == 0  # rollback to 0 is allowed


def test_change_replay_generations(spark):
    rows = [(1, 1, "update", "x", None), (1, 2, "create", "a", "d1"), (1, 3, "create", "b", None),
            (1, 4, "update", None, "d2"), (1, 5, "delete", None, None), (1, 6, "create", "c", None),
            (2, 1, "delete", None, None)]
    log = spark.createDataFrame(rows, "id int, seq int, op string, name string, description string")
    dec = {r["seq"]: r for r in K.replay_changes(log).filter("id = 1").collect()}
    assert [dec[s]["accepted"] for s in range(1, 7)] == [False, True, False, True, True, True]
    cur = {r["id"]: r for r in K.registry_current(K.replay_changes(log)).collect()}
    assert set(cur) == {1}
    assert (cur[1]["name"], cur[1]["description"], cur[1]["is_deleted"], cur[1]["generation"]) == ("c", None, False, 2)


# ------------------------------------------------------------- hooks

def test_retry_and_dead_letters(spark):
    calls = []

    def scorer(chunk, attempt):
        calls.append(attempt)
        err = [("timeout" if (v % 2 == 0 and attempt < 3) else ("bad" if v == 5 else None)) for v in chunk["v"]]
        return pd.DataFrame({"response": [None if e else str(v) for v, e in zip(chunk["v"], err)], "error": err})

    df = spark.range(1, 7).select(F.col("id").alias("v"))
    out = {r["v"]: r for r in H.score_batches(df, scorer, batch_size=2, max_attempts=3).collect()}
    assert out[2]["attempts"] == 3 and out[2]["status"] == "ok"
    assert out[5]["attempts"] == 1 and out[5]["status"] == "dead_letter" and out[5]["error"] == "bad"
    assert out[1]["response"] == "1"


def test_group_metric_is_mergeable(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400).astype("int64"), "x": rng.normal(size=400)})
    pdf["y"] = pdf["x"] * 2 + rng.normal(size=400)
    df = spark.createDataFrame(pdf).repartition(5)

    def partial(p):
        return [len(p), p["x"].sum(), p["y"].sum(), (p["x"] ** 2).sum(), (p["y"] ** 2).sum(), (p["x"] * p["y"]).sum()]

    def finish(s):
        n, sx, sy, sxx, syy, sxy = s
        return (n * sxy - sx * sy) / math.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))

    got = {r["g"]: r["metric_value"] for r in H.group_metric_hook(df, ["g"], ["x", "y"], partial, finish, 6).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.corrcoef(part["x"], part["y"])[0, 1], rel=1e-9)


# ------------------------------------------------------------- schema / ingest

def test_drift_kinds(spark):
    old = spark.createDataFrame([(0, "a", "BIGINT", True), (1, "b", "VARCHAR", True)], C.SCHEMA_TABLE)
    new = spark.createDataFrame([(0, "a", "DOUBLE", True), (1, "c", "VARCHAR", True)], C.SCHEMA_TABLE)
    kinds = {r["column_name"]: r["kind"] for r in C.schema_drift(new, old).collect()}
    assert kinds == {"a": "type_mismatch", "b": "missing", "c": "extra"}
    v = C.drift_verdict(C.schema_drift(new, old)).first()
    assert not v["valid"] and v["warnings"] == ["added: c"]
    assert C.drift_verdict(C.schema_drift(new, None)).first()["valid"]


def test_upload_sequence_and_history(spark, sf_small):
    q = E.queries()
    rep = {r["source"]: r for r in q["multi_file_upload"](spark, sf_small).collect()}
    assert [rep[s]["accepted"] for s in sorted(rep)] == [True, False, True, False, True, False, True, False]
    assert rep["06_notes.txt"]["errors"] == "not a .csv source"
    assert rep["03_extra_note.csv"]["warnings"] == "added: note"
    hist = q["dataset_history"](spark, sf_small).collect()
    assert len(hist) == 30  # the partition holding only a non-Parquet file is skipped
    assert hist[-1]["timestamp"] == "manual-import" and hist[-1]["cumulative_rows"] == 1000


def test_profile_approx_distinct_close(spark, sf_small):
    from vellum.plans.fixtures import Fixtures
    cust = Fixtures(spark, sf_small).customer
    prof = {r["column_name"]: r["approx_distinct"] for r in C.profile(cust).collect()}
    exact = cust.select(F.countDistinct("c_custkey")).first()[0]
    assert abs(prof["c_custkey"] - exact) <= 0.05 * exact


def test_history_counts_empty_upload_and_skips_garbage(spark):
    from vellum.session import scratch_path
    from vellum.sources import ingest as I
    root = scratch_path(spark, "hist-edge")
    df = spark.range(5).select(F.col("id"))
    df.write.parquet(f"{root}/upload=20240101_000000")
    df.limit(0).write.parquet(f"{root}/upload=20240102_000000")
    spark.range(1).select(F.lit("junk").alias("v")).write.text(f"{root}/upload=20240103_000000")
    got = [(r["filename"], r["rows_added"], r["cumulative_rows"]) for r in I.dataset_history(spark, root).collect()]
    assert got == [("20240101_000000", 5, 5), ("20240102_000000", 0, 5)]


def test_search_with_metadata_filters(spark):
    df = _reg(spark)
    eq = R.search_conjunctive(df, metadata_col="metadata", metadata_key="x.y", metadata_value="q")
    assert [r["id"] for r in eq.collect()] == [1]
    has = R.search_conjunctive(df, name="a", metadata_col="metadata", metadata_key="t")
    assert [r["id"] for r in has.collect()] == [1]
    con = R.search_conjunctive(df, metadata_col="metadata", metadata_key="x.y", metadata_value="Q",
                               metadata_match="contains")
    assert [r["id"] for r in con.collect()] == [1]


def test_prefix_sums_null_groups_wide_sums_and_late_years(spark):
    rows = [(None, 1, 2**53 + 1, "9999-12-31 00:00:00"), (None, 2, 1, None), ("g", 1, None, "2300-01-01 00:00:00"), ("g", 2, 5, None)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = prefix_sums(df, ["o"], ["v"], group_cols=["g"], num_partitions=3)
    got = {(r["g"], r["o"]): (r["v_cum"], r["v_total"], r["rows_cum"], r["rows_total"]) for r in out.collect()}
    assert got == {(None, 1): (2**53 + 1, 2**53 + 2, 1, 2), (None, 2): (2**53 + 2, 2**53 + 2, 2, 2),
                   ("g", 1): (0, 5, 1, 2), ("g", 2): (5, 5, 2, 2)}
    assert out.filter("year(t) = 9999").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan


def test_quantile_of_a_hot_value_and_a_null_group(spark):
    vals = [7.0] * 5000 + list(range(5000))
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [(None, 1.0), (None, 3.0), ("b", None)], "k string, x double")
    got = {r["k"]: r["q"] for r in exact_quantile(df, ["k"], "x", 0.95, "q").collect()}
    assert got == pytest.approx({"a": float(np.quantile(vals, 0.95)), None: 2.9})


def test_run_summary_of_a_null_run(spark):
    from vellum.operators import runs as RU

    df = spark.createDataFrame([(None, 200, 1.0), (None, 500, 3.0), (1, 200, 2.0)], "run_id int, status_code int, response_time_ms double")
    got = {r["run_id"]: (r["rows"], r["failed"], r["p95_response_ms"]) for r in RU.run_summary(df).collect()}
    assert got == {None: (2, 1, pytest.approx(2.9)), 1: (1, 0, 2.0)}


def test_run_progress_counts_a_resent_row_once(spark):
    from vellum.operators import runs as RU

    inputs = spark.createDataFrame([(1, 1), (1, 2)], "run_id int, row_id int")
    outputs = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 500), (1, 1, "2024-01-01 00:01:00", 200)],
                                    "run_id int, row_id int, ts string, status_code int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = RU.run_progress(inputs, outputs, "2024-01-02 00:00:00").first()
    assert (r["expected"], r["processed"], r["failed"], r["remaining"]) == (2, 1, 0, 1)


def test_null_labels_are_labels(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("a", "a")], "y_true string, y_pred string")
    pairs = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert pairs == {("a", None): 1, (None, "a"): 1, (None, None): 1, ("a", "a"): 1}
    zero = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df, labels=["a", "b"]).collect()}
    assert zero == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 0, ("b", "b"): 0}
    rep = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in M.classification_report(df).collect()}
    assert rep["a"] == rep[None] == (0.5, 0.5, 2)
    assert rep["macro avg"] == (0.5, 0.5, 4)


def test_many_labels(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("y_true"), (F.col("id") % 1500).alias("y_pred"))
    assert M.confusion_matrix(df).count() == 1500
    assert M.classification_report(df, average="macro").first()["f1"] == 1.0


def test_report_per_run_with_labels_and_average(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "a"), (2, "b", "b")], "run int, y_true string, y_pred string")
    got = {r["run"]: r["recall"] for r in M.classification_report(df, group="run", labels=["a", "b"], average="macro").collect()}
    assert got == {1: 0.5, 2: 0.5}
    micro = {r["run"]: (r["precision"], r["recall"]) for r in M.classification_report(df, group="run", labels=["a"], average="micro").collect()}
    assert micro == {1: (0.5, 1.0), 2: (0.0, 0.0)}


def test_auc_skips_rows_without_label_or_score(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (0, None)], "y_true int, score double")
    assert tuple(M.auc_roc(df).first()) == (1.0, 1, 1)
    per = {r["g"]: r["auc"] for r in M.auc_roc(df.withColumn("g", F.lit(3)), group="g").collect()}
    assert per == {3: 1.0}


def test_reciprocal_rank_takes_text_item_ids(spark):
    df = spark.createDataFrame([(1, "b", 0.5, 2), (1, "a", 0.5, 0), (1, "c", 0.9, 1)], "query_id int, item_id string, score double, grade int")
    assert M.reciprocal_rank_per_query(df).first()["rr"] == pytest.approx(1 / 3)


def test_ilike_takes_a_backslash_before_an_ordinary_character(spark):
    from vellum.functions import scalar as S

    df = spark.createDataFrame([("xaby",), ("xa%by",), ("a\\b",)], "t string")
    hit = lambda p: {r["t"] for r in df.filter(S.ilike("t", p)).collect()}
    assert hit("%a\\b%") == {"xaby"}
    assert hit("%a\\%b%") == {"xa%by"}
    assert hit("%a\\\\b%") == {"a\\b"}


def test_metadata_length_is_that_of_the_escaped_text(spark):
    from vellum.operators import validate as V

    df = spark.createDataFrame([(1, '{"a":"' + "é" * 30_000 + '"}'), (2, '{"a":"' + "e" * 30_000 + '"}'), (3, "[1]"), (4, "x"), (5, None),
                                (6, '{"a":"' + "\U0001F600" * 9_000 + '"}')], "id int, metadata string")
    checked = V.check_metadata(df)
    assert {r["id"]: r["rule"] for r in checked.collect()} == {1: "metadata_too_long", 3: "metadata_not_object", 4: "metadata_not_json", 6: "metadata_too_long"}
    assert checked._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 1


def test_sort_puts_nulls_where_the_listing_does(spark):
    df = spark.createDataFrame([(1, 5, False), (2, None, False), (3, 7, False)], "id int, v int, is_deleted boolean")
    assert [r["id"] for r in R.sort_by(df, "v").collect()] == [1, 3, 2]
    assert [r["id"] for r in R.sort_by(df, "v", descending=True).collect()] == [2, 3, 1]
