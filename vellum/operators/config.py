"""Config versioning and registry changes, replayed from append-only logs.

The reference mutates two integer pointers (current / latest version) and
registry rows one request at a time.  Here a whole log of operations is
replayed at once.  Everything that depends on "what happened before" is
reduced to running counts (two-phase prefix sums, no single-task window per
suite or id) plus equi-joins on (key, ordinal), which are unique and
therefore never skewed; final states are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.pipeline import STEPS
from vellum.plans.prefix import prefix_sums


def replay_config_log(log: DataFrame, suite: str = "suite_id", seq: str = "seq",
                      op: str = "op", target: str = "target") -> DataFrame:
    """K1 + K2: per operation the latest version after it, whether it was
    valid, the current version before and after it.

    save: latest + 1 and current := latest.  rollback: valid iff
    0 <= target <= latest at that moment; sets current only.  The initial
    configure is the state (current 0, latest 0) before the first operation.
    """
    base = log.select(F.col(suite).alias("suite_id"), F.col(seq).alias("seq"), F.col(op).alias("op"),
                      F.col(target).cast("int").alias("target"),
                      (F.col(op) == "save").cast("int").alias("is_save"))
    p1 = prefix_sums(base, ["seq"], ["is_save"], group_cols=["suite_id"]).drop("rows_cum")
    latest = F.col("is_save_cum").cast("bigint")
    valid = (F.col("op") == "save") | ((F.col("op") == "rollback") & (F.col("target") >= 0)
                                       & (F.col("target") <= latest))
    value = F.when(F.col("op") == "save", latest).when(valid, F.col("target").cast("bigint"))
    step = p1.select("suite_id", "seq", "op", "target", latest.alias("latest_version"),
                     valid.alias("valid"), value.alias("value"), valid.cast("int").alias("is_valid"))
    p2 = prefix_sums(step, ["seq"], ["is_valid"], group_cols=["suite_id"]).drop("rows_cum")
    p2 = p2.withColumn("k", F.col("is_valid_cum").cast("bigint"))
    chosen = p2.filter(F.col("valid")).select("suite_id", F.col("k").alias("prev_k"),
                                              F.col("value").alias("previous_version"))
    out = (p2.withColumn("prev_k", F.col("k") - F.col("is_valid"))
           .join(chosen, ["suite_id", "prev_k"], "left")
           .withColumn("previous_version", F.coalesce(F.col("previous_version"), F.lit(0).cast("bigint"))))
    return out.select("suite_id", "seq", "op", "target", "latest_version", "valid", "previous_version",
                      F.when(F.col("valid"), F.col("value")).otherwise(F.col("previous_version"))
                      .alias("current_version"))


def config_versions(replayed: DataFrame) -> DataFrame:
    """K3: current and latest version per suite after the whole log, plus the
    number of rejected operations (one partial aggregate)."""
    return replayed.groupBy("suite_id").agg(
        F.max_by("current_version", "seq").alias("current_version"),
        F.max("latest_version").alias("latest_version"),
        F.count_if(~F.col("valid")).alias("rejected"))


def saved_versions(replayed: DataFrame, bodies: DataFrame, body_seq: str, body_col: str) -> DataFrame:
    """The stored copy of every saved version: (suite_id, version, config)."""
    saves = replayed.filter(F.col("op") == "save").select("suite_id", "seq", F.col("latest_version").alias("version"))
    b = bodies.select(F.col(body_seq).alias("seq"), F.col(body_col).alias("config"))
    return saves.join(b, "seq", "left").select("suite_id", "version", "config")


def config_as_of(versions: DataFrame, saved: DataFrame) -> DataFrame:
    """K4: the config content production shows: the saved copy of each
    suite's current version (version 0 = the initial configure, no body)."""
    return (versions.join(saved, (versions["suite_id"] == saved["suite_id"])
                          & (versions["current_version"] == saved["version"]), "left")
            .select(versions["suite_id"], "current_version", "config"))


def _steps_json(parts: dict[str, Column]) -> Column:
    pieces = [F.when(c.isNotNull(), F.concat(F.lit(f'"{s}":'), c)) for s, c in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def config_patch(current: DataFrame, patches: DataFrame, frozen: DataFrame, key: str = "suite_id",
                 config_col: str = "config", patch_col: str = "patch") -> DataFrame:
    """K5: replace whole named step sections, keep the others (shallow merge).

    A patch naming no section is refused; a suite with live evaluations
    (``frozen``: key, frozen) accepts only the invocation section.  Returns
    (key, accepted, reason, steps) with the merged steps object as JSON text
    (the current one when refused).
    """
    cur = {s: F.get_json_object(F.col(config_col), f"$.workflow.steps.{s}") for s in STEPS}
    pat = {s: F.get_json_object(F.col(patch_col), f"$.{s}") for s in STEPS}
    named = [pat[s].isNotNull() for s in STEPS]
    any_named = named[0]
    for n in named[1:]:
        any_named = any_named | n
    others = F.lit(False)
    for s in STEPS:
        if s != "invocation":
            others = others | pat[s].isNotNull()
    j = (current.join(patches, key, "inner").join(frozen.select(key, "frozen"), key, "left")
         .withColumn("frozen", F.coalesce("frozen", F.lit(False))))
    reason = (F.when(~any_named, F.lit("no section given"))
              .when(F.col("frozen") & others, F.lit("frozen: only invocation may change")))
    merged = _steps_json({s: F.coalesce(pat[s], cur[s]) for s in STEPS})
    kept = _steps_json(cur)
    return j.select(key, reason.isNull().alias("accepted"), reason.alias("reason"),
                    F.when(reason.isNull(), merged).otherwise(kept).alias("steps"))


def config_replace(current: DataFrame, replacements: DataFrame, frozen: DataFrame, key: str = "suite_id",
                   config_col: str = "config", new_col: str = "new_config") -> DataFrame:
    """K6: replace the whole config; refused for frozen suites."""
    j = (current.join(replacements, key, "inner").join(frozen.select(key, "frozen"), key, "left")
         .withColumn("frozen", F.coalesce("frozen", F.lit(False))))
    return j.select(key, (~F.col("frozen")).alias("accepted"),
                    F.when(F.col("frozen"), F.col(config_col)).otherwise(F.col(new_col)).alias("config"))


# --------------------------------------------------------------- registry changes

def replay_changes(log: DataFrame, key: str = "id", seq: str = "seq", op: str = "op",
                   values: list[str] = ("name", "description")) -> DataFrame:
    """Decide every create / update / delete of a change log.

    An update or delete needs a live record, a create needs none.  Whatever
    the acceptance, a record is live after a create and not live after a
    delete, so "live before op i" = "the last create/delete before i was a
    create" -- found by numbering the create/delete ops (prefix count) and
    joining on (key, ordinal).  Accepted creates count the generation.

    ``seq`` numbers a record's operations.  Only keys and kinds of operations go through the
    prefix counts; the values join the decisions on (key, seq) in the end.
    """
    values = list(values)
    base = log.select(F.col(key).alias("id"), F.col(seq).alias("seq"), F.col(op).alias("op"),
                      F.col(op).isin("create", "delete").cast("int").alias("is_cd"))
    p1 = prefix_sums(base, ["seq"], ["is_cd"], group_cols=["id"]).drop("rows_cum")
    p1 = p1.withColumn("k", F.col("is_cd_cum").cast("bigint"))
    cd = p1.filter(F.col("is_cd") == 1).select("id", F.col("k").alias("prev_k"), F.col("op").alias("prev_cd"))
    j = p1.withColumn("prev_k", F.col("k") - F.col("is_cd")).join(cd, ["id", "prev_k"], "left")
    live_before = F.coalesce(F.col("prev_cd") == "create", F.lit(False))
    accepted = F.when(F.col("op") == "create", ~live_before).otherwise(live_before)
    j = j.select("id", "seq", "op", accepted.alias("accepted"),
                 ((F.col("op") == "create") & accepted).cast("int").alias("acc_create"))
    p2 = prefix_sums(j, ["seq"], ["acc_create"], group_cols=["id"]).drop("rows_cum")
    decided = p2.select("id", "seq", "op", "accepted", F.col("acc_create_cum").cast("bigint").alias("generation"))
    if not values:
        return decided
    payload = log.select(F.col(key).alias("_id"), F.col(seq).alias("_seq"), *values)
    return (decided.join(payload, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq")))
            .select("id", "seq", "op", *values, "accepted", "generation"))


def registry_current(decided: DataFrame, values: list[str] = ("name", "description")) -> DataFrame:
    """The current registry from the decided log: per id the last
    generation, each value = the last non-null value set by an accepted op of
    that generation (null = keep), deleted when the last create/delete was a
    delete.  Ids never created are absent.  One partial aggregate."""
    values = list(values)
    order = F.struct("generation", "seq")
    aggs = [F.max("generation").alias("generation"),
            F.max_by(F.col("op"), F.when(F.col("op").isin("create", "delete"), F.col("seq"))).alias("_last_cd")]
    for v in values:
        ok = F.col("accepted") & F.col(v).isNotNull()
        aggs.append(F.max_by(F.struct(F.col("generation").alias("g"), F.col(v).alias("v")),
                             F.when(ok, order)).alias(f"_{v}"))
    agg = decided.groupBy("id").agg(*aggs).filter(F.col("generation") > 0)
    return agg.select("id", *[F.when(F.col(f"_{v}.g") == F.col("generation"), F.col(f"_{v}.v")).alias(v)
                              for v in values],
                      (F.col("_last_cd") == "delete").alias("is_deleted"), "generation")
