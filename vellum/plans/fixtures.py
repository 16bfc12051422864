"""Fixture views: registry, run and prediction tables derived from the base tables.

Each view is one SQL text that both Spark and DuckDB accept.  Placeholders in
braces name base tables or other fixtures; Spark binds them to DataFrames
(``spark.sql(text, **frames)``, no global temp views), the oracle side renders
them as plain names inside a ``WITH`` block.  The views are *inputs*: every
operator under test is written with the DataFrame API against them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vellum.sources.tables import BASE_TABLES, Tables

# Fixed view texts (shared by the Spark plans and the DuckDB oracles).
FIXTURE_SQL: dict[str, str] = {
    "reg_datasets": """
select n.n_nationkey as id, n.n_name as name, r.r_name as description, coalesce(x.n_rows,0) as total_rows, x.created_at, (n.n_nationkey % 7 = 3) as is_deleted
from {nation} n join {region} r on n.n_regionkey=r.r_regionkey
left join (select c_nationkey, count(*) as n_rows, min(o_orderdate) as created_at from {customer} join {orders} on o_custkey=c_custkey group by c_nationkey) x on x.c_nationkey=n.n_nationkey
""",
    "reg_suites": """
select c.c_custkey as id, c.c_name as name, c.c_mktsegment as description, case when c.c_acctbal<0 then null else c.c_nationkey end as dataset_id, coalesce(x.n,0) as total_evals,
 case when c.c_mktsegment in ('AUTOMOBILE','BUILDING') then 'ready' when c.c_mktsegment='FURNITURE' then 'running' else 'failed' end as status, x.created_at, (c.c_custkey % 11 = 0) as is_deleted
from {customer} c left join (select o_custkey, count(*) as n, min(o_orderdate) as created_at from {orders} group by o_custkey) x on x.o_custkey=c.c_custkey
""",
    "reg_evals": """
select e.id, concat('Eval ', cast(e.id as string)) as name, e.description, e.suite_id, s.dataset_id, e.total_requests, e.successful_requests, e.failed_requests, e.status, e.created_at,
 case when e.status='pending' then null else e.created_at end as started_at, case when e.status='completed' then e.last_ship end as completed_at, e.is_deleted
from (select o.o_orderkey as id, o.o_orderpriority as description, o.o_custkey as suite_id, coalesce(x.n,0) as total_requests, coalesce(x.ok,0) as successful_requests, coalesce(x.n-x.ok,0) as failed_requests,
  case when o.o_orderkey % 13 = 0 then 'failed' when o.o_orderstatus='F' then 'completed' when o.o_orderstatus='O' then 'running' else 'pending' end as status,
  o.o_orderdate as created_at, greatest(o.o_orderdate, x.last_ship) as last_ship, (o.o_orderkey % 17 = 0) as is_deleted
 from {orders} o left join (select l_orderkey, count(*) as n, sum(case when l_returnflag<>'R' then 1 else 0 end) as ok, max(l_shipdate) as last_ship from {lineitem} group by l_orderkey) x on x.l_orderkey=o.o_orderkey) e
left join {reg_suites} s on s.id=e.suite_id
""",
    "run_outputs": """
select event_id as row_id, user_id as run_id, cast(event_id % 50 as bigint) as batch_id, ts, case when event_type='error' then 500 else 200 end as status_code, value as response_time_ms, props as payload from {events}
""",
    "responses": """
select event_id as row_id, concat('{{"content":{{"choices":[{{"text":"r', cast(event_id as string), '"}}]}},"props":', props, '}}') as response from {events}
""",
    "config_log": """
select user_id as suite_id, event_id as seq, case when event_type='purchase' then 'save' else 'rollback' end as op, cast(floor(value) as int) % 12 as target from {events} where event_type in ('purchase','error')
""",
    "change_log": """
select user_id as id, event_id as seq, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as op,
 case when event_type in ('signup','view') then concat('name ', cast(event_id as string)) end as name, case when event_type in ('signup','click') then event_type end as description from {events}
""",
    "pred_binary": """
select l.doc_id as row_id, l.quality as y_true, case when d.n_chars>=400 then 1 else 0 end as y_pred, cast(d.n_chars as double) as score from {labels} l join {documents} d on d.doc_id=l.doc_id
""",
    "pred_class": """
select l_orderkey, l_linenumber, l_returnflag as y_true, case when l_linestatus='F' then 'A' when l_quantity>25 then 'N' else 'R' end as y_pred from {lineitem}
""",
    "pred_reg": """
select l_orderkey, l_linenumber, l_extendedprice as y_true, l_quantity*p_retailprice as y_pred from {lineitem} join {part} on p_partkey=l_partkey
""",
    "pred_rank": """
select o_custkey as query_id, o_orderkey as item_id, o_totalprice as score, case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end as grade from {orders}
""",
    "gap_class": """
select case when l_linenumber = 7 then null else l_linenumber end as run_id, case when l_orderkey % 5 = 1 then null else y_true end as y_true,
 case when l_orderkey % 6 = 1 then null else y_pred end as y_pred from {pred_class}
""",
    "gap_reg": """
select case when l_linenumber = 7 then null else l_linenumber end as run_id, case when l_orderkey % 5 = 1 then null else y_true end as y_true,
 case when l_orderkey % 6 = 1 then null else y_pred end as y_pred from {pred_reg}
""",
    "gap_rank": """
select case when query_id % 3 = 0 then null else query_id % 3 end as run_id, case when query_id % 10 = 1 then null else query_id end as query_id, item_id, score, grade
from {pred_rank}
""",
    "pred_text": """
select u.conv_id, u.turn, u.text as reference, a.text as output from {conversations} u join {conversations} a on a.conv_id=u.conv_id and a.turn=u.turn+1 where u.role='user' and a.role='assistant'
""",
    "pred_vec": """
select a.vec_id, a.embedding as output_vec, b.embedding as truth_vec from {embeddings} a join {embeddings} b on b.vec_id=a.vec_id+1
""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def fixture_deps(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = Tables(spark, sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return getattr(self.tables, name)
        if name not in self._cache:
            frames = {dep: self.get(dep) for dep in fixture_deps(name)}
            self._cache[name] = self.spark.sql(FIXTURE_SQL[name], **frames)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in FIXTURE_SQL or name in BASE_TABLES:
            return self.get(name)
        raise AttributeError(name)


def _render(name: str) -> str:
    names = {dep: dep for dep in fixture_deps(name)}
    return FIXTURE_SQL[name].format(**names).strip()


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in order:
            return
        for dep in fixture_deps(n):
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(body: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the fixtures it reads.

    ``body`` may itself start with ``with``; its CTEs are appended after the
    fixture CTEs.
    """
    ctes = [f"{n} as ({_render(n)})" for n in _closure(names)]
    body = body.strip()
    if body[:4].lower() == "with" and body[4].isspace():
        rest = body[5:].lstrip()
        if rest[:9].lower() == "recursive":
            raise ValueError("recursive CTEs are not supported here")
        return "with " + ",\n".join(ctes + [rest]) if ctes else body
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body
