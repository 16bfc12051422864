"""Config replay (K1-K6) and registry change replay (R1, W2) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import config as K
from vellum.operators import incremental as INC
from vellum.operators import registry as R
from vellum.plans.fixtures import Fixtures, with_fixtures
from vellum.plans.pipeline_queries import _workflow_configs

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


_REPLAY_SQL = """
with l as (select suite_id, seq, op, target,
  cast(sum(case when op = 'save' then 1 else 0 end) over (partition by suite_id order by seq rows between unbounded preceding and current row) as bigint) as latest_version
  from config_log),
v as (select *, op = 'save' or (op = 'rollback' and target >= 0 and target <= latest_version) as valid,
  case when op = 'save' then latest_version when op = 'rollback' and target >= 0 and target <= latest_version then cast(target as bigint) end as val from l),
c as (select *, cast(coalesce(last_value(val ignore nulls) over (partition by suite_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as previous_version from v),
r as (select suite_id, seq, op, target, latest_version, valid, previous_version, case when valid then val else previous_version end as current_version from c)
"""


def _replayed(fx: Fixtures):
    return K.replay_config_log(fx.config_log)


@query("config_save", _REPLAY_SQL + "select suite_id, seq, latest_version, current_version from r where op = 'save'", ["config_log"])
def config_save(fx: Fixtures):
    return _replayed(fx).filter(F.col("op") == "save").select("suite_id", "seq", "latest_version", "current_version")


@query("config_rollback", _REPLAY_SQL + """
select suite_id, seq, target, latest_version, valid, previous_version, current_version from r where op = 'rollback'
""", ["config_log"])
def config_rollback(fx: Fixtures):
    return _replayed(fx).filter(F.col("op") == "rollback").select(
        "suite_id", "seq", "target", "latest_version", "valid", "previous_version", "current_version")


_VERSIONS_SQL = _REPLAY_SQL + """,
fin as (select suite_id, arg_max(current_version, seq) as current_version, max(latest_version) as latest_version,
  count(*) filter (where not valid) as rejected from r group by suite_id)
"""


@query("config_versions", _VERSIONS_SQL + "select * from fin", ["config_log"])
def config_versions(fx: Fixtures):
    return K.config_versions(_replayed(fx))


@query("config_as_of", _VERSIONS_SQL + """,
saved as (select r.suite_id, r.latest_version as version, b.response as config from r left join responses b on b.row_id = r.seq where r.op = 'save')
select f.suite_id, f.current_version, s.config from fin f left join saved s on s.suite_id = f.suite_id and s.version = f.current_version
""", ["config_log", "responses"])
def config_as_of(fx: Fixtures):
    rep = _replayed(fx)
    saved = K.saved_versions(rep, fx.responses, "row_id", "response")
    return K.config_as_of(K.config_versions(rep), saved)


# Sections of the demo patches.
_INVOCATION_PATCH = '"invocation":{"description":"ask the model","script":"ask.py","input":{"url":"http://scorer/","method":"POST"}}'
_EVALUATION_PATCH = '"evaluation":{"description":"grade it","script":"grade.py","input":{"metrics":["bleu"]}}'


def _patches(fx: Fixtures):
    s = R.live(fx.reg_suites)
    patch = (F.when(F.col("description") == "HOUSEHOLD", F.lit('{"unknown":1}'))
             .when(F.col("dataset_id").isNull(), F.lit("{" + _INVOCATION_PATCH + "," + _EVALUATION_PATCH + "}"))
             .otherwise(F.lit("{" + _INVOCATION_PATCH + "}")))
    return s.select(F.col("id").alias("suite_id"), patch.alias("patch"))


def _frozen(fx: Fixtures):
    return R.suite_frozen(fx.reg_suites, fx.reg_evals).select(F.col("id").alias("suite_id"), "frozen")


_PATCH_SQL = """
with fr as (select s.id as suite_id, s.status, s.description, s.dataset_id, exists (select 1 from reg_evals e where e.suite_id = s.id and not e.is_deleted) as frozen
  from reg_suites s where not s.is_deleted),
p as (select *, case when description = 'HOUSEHOLD' then 'none' when dataset_id is null then 'inv_eval' else 'inv' end as kind from fr),
d as (select *, case when kind = 'none' then 'no section given' when frozen and kind = 'inv_eval' then 'frozen: only invocation may change' end as reason from p)
select suite_id, reason is null as accepted, reason,
 case when reason is null then 'POST' else 'GET' end as method,
 case when reason is null and kind = 'inv_eval' then '["bleu"]'
      when status <> 'failed' then cast(to_json(['similarity', description]) as varchar) end as metrics
from d
"""


@query("config_patch", _PATCH_SQL, ["reg_suites", "reg_evals"])
def config_patch(fx: Fixtures):
    out = K.config_patch(_workflow_configs(fx), _patches(fx), _frozen(fx))
    return out.select("suite_id", "accepted", "reason",
                      F.get_json_object("steps", "$.invocation.input.method").alias("method"),
                      F.get_json_object("steps", "$.evaluation.input.metrics").alias("metrics"))


@query("config_replace", """
select s.id as suite_id, not exists (select 1 from reg_evals e where e.suite_id = s.id and not e.is_deleted) as accepted,
 case when exists (select 1 from reg_evals e where e.suite_id = s.id and not e.is_deleted) then 'GET' else 'PUT' end as method
from reg_suites s where not s.is_deleted
""", ["reg_suites", "reg_evals"])
def config_replace(fx: Fixtures):
    new_doc = ('{"workflow":{"name":"replaced","steps":{"invocation":{"description":"put the question",'
               '"script":"put.py","input":{"url":"http://scorer/","method":"PUT"}}}}}')
    repl = R.live(fx.reg_suites).select(F.col("id").alias("suite_id"), F.lit(new_doc).alias("new_config"))
    out = K.config_replace(_workflow_configs(fx), repl, _frozen(fx))
    return out.select("suite_id", "accepted",
                      F.get_json_object("config", "$.workflow.steps.invocation.input.method").alias("method"))


_CHANGES_SQL = """
with l as (select *, case when op in ('create', 'delete') then op end as cd from change_log),
a as (select *, coalesce(last_value(cd ignore nulls) over (partition by id order by seq rows between unbounded preceding and 1 preceding) = 'create', false) as live_before from l),
b as (select *, case when op = 'create' then not live_before else live_before end as accepted from a),
c as (select *, cast(sum(case when op = 'create' and accepted then 1 else 0 end) over (partition by id order by seq rows between unbounded preceding and current row) as bigint) as generation from b)
"""


@query("apply_changes", _CHANGES_SQL + "select id, seq, op, accepted, generation from c", ["change_log"])
def apply_changes(fx: Fixtures):
    return K.replay_changes(fx.change_log).select("id", "seq", "op", "accepted", "generation")


@query("registry_current", _CHANGES_SQL + """,
g as (select id, max(generation) as generation, arg_max(op, seq) filter (where cd is not null) as last_cd from c group by id having max(generation) > 0),
nm as (select c.id, arg_max(c.name, c.seq) filter (where c.accepted and c.name is not null and c.generation = g.generation) as name,
  arg_max(c.description, c.seq) filter (where c.accepted and c.description is not null and c.generation = g.generation) as description
  from c join g on g.id = c.id group by c.id)
select g.id, nm.name, nm.description, g.last_cd = 'delete' as is_deleted, g.generation from g join nm on nm.id = g.id
""", ["change_log"])
def registry_current(fx: Fixtures):
    return K.registry_current(K.replay_changes(fx.change_log))


# --------------------------------------------------------------- by segments, from a stored state

SEGMENTS = 5


@query("config_versions_by_segment", _VERSIONS_SQL + "select * from fin", ["config_log"])
def config_versions_by_segment(fx: Fixtures):
    """The log in segments: the first ones are replayed to a state, the others are summarised each on its own,
    composed and applied to it."""
    log = fx.config_log.withColumn("segment", (F.col("seq") * SEGMENTS / (F.lit(1) + fx.config_log.agg(F.max("seq")).scalar())).cast("int"))
    state = K.config_versions(K.replay_config_log(log.filter("segment < 2")))
    later = INC.compose_segments(INC.segment_summaries(log.filter("segment >= 2"), "segment"))
    return INC.apply_summaries(state, later).select("suite_id", "current_version", "latest_version", "rejected")


@query("registry_current_by_segment", O["registry_current"])
def registry_current_by_segment(fx: Fixtures):
    """The registry kept as a table; every segment of the log is applied to what the one before left."""
    cut = fx.change_log.agg((F.max("seq") / 2).cast("long")).scalar()
    state = INC.apply_changes_to(None, fx.change_log.filter(F.col("seq") <= cut))
    return INC.apply_changes_to(state, fx.change_log.filter(F.col("seq") > cut))
