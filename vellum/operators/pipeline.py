"""The data side of the four workflow steps, set-at-a-time.

preprocess (E1/E2) -> invocation (hooks.score_batches) -> postprocess
(E3/E4) -> alignment with ground truth (E5) -> metric dispatch (E6).  Config
step access (E7) reads workflow documents held as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import metrics as M
from vellum.session import fresh

# The four workflow steps, in order.
STEPS = ["preprocessing", "invocation", "postprocessing", "evaluation"]


class PipelineError(ValueError):
    pass


def preprocess_select(df: DataFrame, input_columns: list[str] | None, groundtruth_column: str | None,
                      keys: list[str] = ()) -> DataFrame:
    """``input`` = the named columns (all columns when none are named,
    ground truth included), ``groundtruth`` = that column (null when not
    given).  Every named column must exist -- checked on the schema only."""
    have = set(df.columns)
    input_columns = list(input_columns or [])
    if input_columns and not set(input_columns) <= have:
        raise PipelineError(f"no such input columns: {sorted(set(input_columns) - have)}")
    if groundtruth_column and groundtruth_column not in have:
        raise PipelineError(f"no such ground-truth column: {groundtruth_column}")
    cols = input_columns or [c for c in df.columns]
    gt = F.col(groundtruth_column) if groundtruth_column else F.lit(None)
    return df.select(*keys, F.struct(*[F.col(c) for c in cols]).alias("input"), gt.alias("groundtruth"))


def input_mapping(df: DataFrame, mapping: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Request body as JSON text, dataset columns renamed (target <- source)."""
    body = F.to_json(F.struct(*[F.col(src).alias(dst) for dst, src in mapping.items()]))
    return df.select(*keys, body.alias("request_body"))


def _key_path(step: str) -> str:
    return "$['" + step.replace("\\", "\\\\").replace("'", "\\'") + "']"


def extract_path(response: Column, path) -> tuple[Column, Column]:
    """Walk ``path`` through a JSON response.

    A digit step indexes a list and is a key on an object; a missing key, an
    index past the end, or a scalar on the way is an error.  Returns
    (output text, error message); a string path is one step.
    """
    if isinstance(path, str):
        path = [path]
    start = F.struct(F.try_parse_json(response).alias("v"),
                     F.when(response.isNotNull() & F.try_parse_json(response).isNull(), F.lit("no valid JSON")).alias("err"))
    state = F.array(start)
    for step in path:
        state = F.transform(state, _walk(step))
    done = F.transform(state, lambda s: F.struct(
        F.when(s["err"].isNull(), F.try_variant_get(s["v"], "$", "string")).alias("out"), s["err"].alias("err")))[0]
    return done["out"], done["err"]


# A digit is an index or a key, so a path with n digits reads one of 2 ** n places.
MOST_DIGITS = 3


def _place(v: Column, path) -> Column:
    """``extract_path``'s output without its error: what stands at the end of ``path`` in a parsed response.  A list has
    no keys and an object no indexes, so at most one of the path's readings is there."""
    path = [path] if isinstance(path, str) else list(path)
    readings = ["$"]
    for step in path:
        ways = [_key_path(step)[1:]]
        if step.isdigit():
            ways.insert(0, f"[{int(step)}]")
        readings = [r + w for r in readings for w in ways]
    return F.coalesce(*[F.try_variant_get(v, r, "string") for r in readings])


def _plain(path) -> bool:
    """Whether ``_place`` reads this path."""
    path = [path] if isinstance(path, str) else list(path)
    return sum(s.isdigit() for s in path) <= MOST_DIGITS and not any(set(s) & set("\\'") for s in path)


def _walk(step: str):
    """One step of a path over (value, error).  The step before is a lambda's
    variable, so the expression grows with the path's length, not its power."""
    def run(s: Column) -> Column:
        by_key = F.try_variant_get(s["v"], _key_path(step), "variant")
        found = F.coalesce(F.try_variant_get(s["v"], f"$[{int(step)}]", "variant"), by_key) if step.isdigit() else by_key
        return F.transform(F.array(F.struct(found.alias("n"))), lambda x: F.struct(
            x["n"].alias("v"),
            F.when(s["err"].isNotNull(), s["err"]).when(s["v"].isNotNull() & x["n"].isNull(), _why(s["v"], step)).alias("err")))[0]
    return run


def _why(v: Column, step: str) -> Column:
    kind = F.schema_of_variant(v)
    return (F.when(kind.startswith("OBJECT"), F.lit(f"no key {step!r} in the object"))
            .when(kind.startswith("ARRAY") & F.lit(step.isdigit()), F.lit(f"no element {step} in the list"))
            .otherwise(F.concat(F.lit(f"no step {step!r} into "), kind)))


def postprocess_path(df: DataFrame, response_col: str, path, keys: list[str] = ()) -> DataFrame:
    """One output per response plus its error message."""
    out, err = extract_path(F.col(response_col), path)
    return df.select(*keys, out.alias("output"), err.alias("error_message"))


def output_mapping(df: DataFrame, response_col: str, paths: dict, keys: list[str] = ()) -> DataFrame:
    """Several named outputs from one response (one column per name), parsed once."""
    parsed, response = fresh(df, "_parsed")[0], F.col(response_col)
    cols = [(_place(F.col(parsed), path) if _plain(path) else extract_path(response, path)[0]).alias(name) for name, path in paths.items()]
    return df.withColumn(parsed, F.try_parse_json(response)).select(*keys, *cols)


def align_truth(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """E5: every input row with its output (null when none) and a matched
    flag; ``matched`` = false rows are the unmatched report (an anti join)."""
    o = outputs.withColumn("_hit", F.lit(True))
    return (inputs.join(o, keys, "left")
            .withColumn("matched", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


# Row metrics by name: (output, truth) -> Column of double.
ROW_METRICS = {
    "exact_match": lambda o, t: (o == t).cast("double"),
    "abs_error": lambda o, t: F.abs(o - t).cast("double"),
    "squared_error": lambda o, t: ((o - t) * (o - t)).cast("double"),
    "similarity": lambda o, t: M.cosine_similarity(o.cast("array<double>"), t.cast("array<double>")),
    "length_ratio": lambda o, t: (F.length(o) / F.greatest(F.length(t), F.lit(1))).cast("double"),
}


def metric_dispatch(df: DataFrame, output_col: str, truth_col: str, metrics: list[str],
                    keys: list[str]) -> DataFrame:
    """Only the named metrics, unknown names silently ignored; result as
    the long table (keys..., metric_name, metric_value)."""
    chosen = [m for m in dict.fromkeys(metrics) if m in ROW_METRICS]
    if not chosen:
        return df.select(*keys, F.lit(None).cast("string").alias("metric_name"),
                         F.lit(None).cast("double").alias("metric_value")).limit(0)
    o, t = F.col(output_col), F.col(truth_col)
    wide = df.select(*keys, *[ROW_METRICS[m](o, t).alias(m) for m in chosen])
    return wide.unpivot(keys, chosen, "metric_name", "metric_value")


def extract_step(configs: DataFrame, step: str, config_col: str = "config",
                 keys: list[str] = ("suite_id",)) -> DataFrame:
    """One step's description, script and input (JSON text) from each
    workflow document; an absent part comes back as ''."""
    if step not in STEPS:
        raise PipelineError(f"unknown step {step!r}")
    base = f"$.workflow.steps.{step}"
    c = F.col(config_col)
    return configs.select(
        *keys,
        F.coalesce(F.get_json_object(c, f"{base}.description"), F.lit("")).alias("description"),
        F.coalesce(F.get_json_object(c, f"{base}.script"), F.lit("")).alias("script"),
        F.coalesce(F.get_json_object(c, f"{base}.input"), F.lit("")).alias("input"))
