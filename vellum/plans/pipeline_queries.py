"""Evaluation-pipeline (E1-E7) and hook (H1-H5) queries, with oracles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from vellum.operators import hooks as H
from vellum.operators import pipeline as P
from vellum.plans.fixtures import Fixtures, with_fixtures

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


@query("preprocess_select", """
select c_custkey, to_json(struct_pack(c_name := c_name, c_mktsegment := c_mktsegment)) as input, c_acctbal as groundtruth from customer
""")
def preprocess_select(fx: Fixtures):
    r = P.preprocess_select(fx.customer, ["c_name", "c_mktsegment"], "c_acctbal", keys=["c_custkey"])
    return r.select("c_custkey", F.to_json("input").alias("input"), "groundtruth")


@query("input_mapping", """
select doc_id, to_json(struct_pack(prompt := text, language := lang)) as request_body from documents
""")
def input_mapping(fx: Fixtures):
    return P.input_mapping(fx.documents, {"prompt": "text", "language": "lang"}, keys=["doc_id"])


# The answer path of the responses fixture.
ANSWER_PATH = ["content", "choices", "0", "text"]


@query("postprocess_path", """
select row_id, json_extract_string(response, '$.content.choices[0].text') as output, cast(null as varchar) as error_message from responses
""", ["responses"])
def postprocess_path(fx: Fixtures):
    return P.postprocess_path(fx.responses, "response", ANSWER_PATH, keys=["row_id"])


@query("output_mapping", """
select row_id, json_extract_string(response, '$.content.choices[0].text') as answer, json_extract_string(response, '$.props.k') as k,
 cast(null as varchar) as missing from responses
""", ["responses"])
def output_mapping(fx: Fixtures):
    return P.output_mapping(fx.responses, "response",
                            {"answer": ANSWER_PATH, "k": ["props", "k"], "missing": ["props", "z"]}, keys=["row_id"])


@query("align_truth", """
with o as (select r.row_id, json_extract_string(r.response, '$.content.choices[0].text') as output
  from responses r join events e on e.event_id = r.row_id where e.event_type <> 'error')
select e.event_id as row_id, e.event_type as groundtruth, o.output, o.row_id is not null as matched
from events e left join o on o.row_id = e.event_id
""", ["responses"])
def align_truth(fx: Fixtures):
    ok = fx.events.filter(F.col("event_type") != "error").select(F.col("event_id").alias("row_id"))
    outs = P.postprocess_path(fx.responses.join(ok, "row_id", "left_semi"), "response", ANSWER_PATH,
                              keys=["row_id"]).select("row_id", "output")
    inputs = fx.events.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("groundtruth"))
    return P.align_truth(inputs, outs, ["row_id"]).select("row_id", "groundtruth", "output", "matched")


@query("metric_dispatch", """
select l_orderkey, l_linenumber, metric_name, round(metric_value, 4) as metric_value from (
 select l_orderkey, l_linenumber, 'abs_error' as metric_name, abs(y_pred - y_true) as metric_value from pred_reg
 union all
 select l_orderkey, l_linenumber, 'squared_error', (y_pred - y_true) * (y_pred - y_true) from pred_reg)
""", ["pred_reg"])
def metric_dispatch(fx: Fixtures):
    long = P.metric_dispatch(fx.pred_reg, "y_pred", "y_true", ["abs_error", "squared_error", "no_such_metric"],
                             keys=["l_orderkey", "l_linenumber"])
    return long.select("l_orderkey", "l_linenumber", "metric_name", F.round("metric_value", 4).alias("metric_value"))


def _workflow_configs(fx: Fixtures):
    """Workflow documents per suite (template shape); failed suites have no
    evaluation step."""
    s = fx.reg_suites
    step = lambda d, script, inp: F.struct(F.lit(d).alias("description"), F.lit(script).alias("script"),
                                           inp.alias("input"))
    steps = F.struct(
        step("pick the columns", "prepare.py",
             F.struct(F.array(F.lit("c_name")).alias("input_columns"), F.lit("c_acctbal").alias("groundtruth_column"))).alias("preprocessing"),
        step("ask the model", "ask.py",
             F.struct(F.lit("http://model.example/ask").alias("url"), F.lit("GET").alias("method"))).alias("invocation"),
        step("read the answer", "answer.py", F.struct(F.lit("message").alias("field"))).alias("postprocessing"),
        F.when(F.col("status") != "failed",
               step("grade it", "grade.py",
                    F.struct(F.array(F.lit("similarity"), F.col("description")).alias("metrics")))).alias("evaluation"))
    wf = F.struct(F.struct(F.col("name").alias("name"), F.col("description").alias("description"),
                           F.lit(0).alias("version"), steps.alias("steps")).alias("workflow"))
    return s.select(F.col("id").alias("suite_id"), F.to_json(wf).alias("config"))


@query("extract_step", """
with c as (select id as suite_id, case when status <> 'failed' then 'grade it' end as d,
  case when status <> 'failed' then 'grade.py' end as s,
  case when status <> 'failed' then cast(to_json(struct_pack(metrics := ['similarity', description])) as varchar) end as i from reg_suites)
select suite_id, coalesce(d, '') as description, coalesce(s, '') as script, coalesce(i, '') as input from c
""", ["reg_suites"])
def extract_step(fx: Fixtures):
    return P.extract_step(_workflow_configs(fx), "evaluation")


# ------------------------------------------------------------------ hooks

def _text_shape(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len().astype("int64"),
                         "n_lines": (pdf["text"].str.count("\n") + 1).astype("int64")})


@query("hook_preprocess", """
select doc_id, length(text) as n_chars, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines from documents
""")
def hook_preprocess(fx: Fixtures):
    return H.preprocess_hook(fx.documents.select("doc_id", "text"), _text_shape,
                             "doc_id long, n_chars long, n_lines long")


def demo_scorer(chunk: pd.DataFrame, attempt: int) -> pd.DataFrame:
    """Deterministic stand-in for the model under test: labels a document by
    length; texts carrying a license line are refused (not retryable), texts
    whose length is a multiple of 5 time out on the first attempt."""
    resp, err = [], []
    for text in chunk["text"]:
        if "license" in text:
            resp.append(None)
            err.append("bad_request")
        elif len(text) % 5 == 0 and attempt == 1:
            resp.append(None)
            err.append("timeout")
        else:
            resp.append(json.dumps({"label": "long" if len(text) >= 400 else "short", "n_chars": len(text)}))
            err.append(None)
    return pd.DataFrame({"response": resp, "error": err})


_SCORE_SQL = """
with s as (select doc_id, contains(text, 'license') as refused, length(text) % 5 = 0 as slow, length(text) as n from documents)
select doc_id,
 case when refused then null else concat('{"label": "', case when n >= 400 then 'long' else 'short' end, '", "n_chars": ', cast(n as varchar), '}') end as response,
 case when refused then 'bad_request' end as error, cast(case when not refused and slow then 2 else 1 end as int) as attempts,
 case when refused then 'dead_letter' else 'ok' end as status from s
"""


def _scored(fx: Fixtures):
    return H.score_batches(fx.documents.select("doc_id", "text"), demo_scorer, batch_size=50, workers=8,
                           max_attempts=3)


@query("hook_score_batches", _SCORE_SQL)
def hook_score_batches(fx: Fixtures):
    return _scored(fx).select("doc_id", "response", "error", "attempts", "status")


@query("hook_retry_dlq", "select doc_id, error, attempts from (" + _SCORE_SQL + ") where status = 'dead_letter'")
def hook_retry_dlq(fx: Fixtures):
    _, dead = H.split_dead_letters(_scored(fx))
    return dead.select("doc_id", "error", "attempts")


def _length_gap(output: pd.Series, reference: pd.Series) -> pd.Series:
    lo, lr = output.str.len(), reference.str.len()
    return (lo - lr).abs() / lr.clip(lower=1)


@query("hook_row_metric", """
select conv_id, turn, round(abs(length(output) - length(reference)) / greatest(length(reference), 1), 6) as length_gap from pred_text
""", ["pred_text"])
def hook_row_metric(fx: Fixtures):
    udf = H.row_metric_hook(_length_gap)
    return fx.pred_text.select("conv_id", "turn", F.round(udf("output", "reference"), 6).alias("length_gap"))


def _corr_partial(pdf: pd.DataFrame) -> list[float]:
    x, y = pdf["y_true"].astype(float), pdf["y_pred"].astype(float)
    return [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]


def _corr_finish(s: list[float]) -> float:
    n, sx, sy, sxx, syy, sxy = s
    den = ((n * sxx - sx * sx) * (n * syy - sy * sy)) ** 0.5
    return float("nan") if den == 0 else (n * sxy - sx * sy) / den


@query("hook_group_metric", """
select l_linenumber, round(corr(y_true, y_pred), 6) as metric_value from pred_reg group by l_linenumber
""", ["pred_reg"])
def hook_group_metric(fx: Fixtures):
    m = H.group_metric_hook(fx.pred_reg, ["l_linenumber"], ["y_true", "y_pred"], _corr_partial, _corr_finish, 6)
    return m.select("l_linenumber", F.round("metric_value", 6).alias("metric_value"))
