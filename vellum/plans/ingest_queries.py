"""Ingest, schema, history and set-operation queries (S, C, U, W1, W5, L2, A1,
A6, A7, V9).

File fixtures are written by Spark from the base tables into a fresh folder
under the shared checkpoint root on every call:

* drift set -- ``orders`` split into upload sources (base columns, a missing
  column, an extra column, text in a number column, an upper-case ``.CSV``,
  a ``.txt``, a time-only column, a header-only file);
* history set -- ``events`` split by day into ``upload=YYYYMMDD_000000``
  partitions, the last day under a name that is no stamp, plus a partition
  holding only a file that is not Parquet.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from vellum.functions import metrics as M
from vellum.functions import scalar as S
from vellum.operators import registry as R
from vellum.operators import schema as C
from vellum.plans.fixtures import Fixtures, with_fixtures
from vellum.plans.sqltext import iso_sql
from vellum.session import scratch_path
from vellum.sources import ingest as I
from vellum.sources.tables import BASE_TABLES

Q: dict = {}
O: dict[str, str] = {}


def query(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = with_fixtures(sql, *fixtures)
        return fn
    return deco


# The clock of the fixture uploads (one second apart).
UPLOAD_CLOCK = _dt.datetime(2024, 2, 1, 9, 0, 0)
DRIFT_DATASET = "orders_uploads"


def write_drift_set(fx: Fixtures) -> str:
    spark = fx.spark
    root = scratch_path(spark, "drift-set")
    o = fx.orders
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
                    F.col("o_totalprice").alias("amt"), (F.col("o_orderstatus") == "F").alias("flag"),
                    F.to_date("o_orderdate").alias("d"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderstatus").alias("_st"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("note"))
    cols = ["id", "name", "amt", "flag", "d", "ts"]
    st, pr = F.col("_st"), F.col("name")
    I.stage_csv(base.filter(st == "F").select(*cols), f"{root}/01_base.csv")
    I.stage_csv(base.filter(st == "O").select("id", "name", "flag", "d", "ts"), f"{root}/02_missing_amt.csv")
    I.stage_csv(base.filter(st == "P").select(*cols, "note"), f"{root}/03_extra_note.csv")
    I.stage_csv(base.filter(pr == "1-URGENT").select("id", "name", F.concat(F.lit("n/a "), F.col("amt").cast("string")).alias("amt"),
                                                     "flag", "d", "ts", "note"), f"{root}/04_amt_text.csv")
    I.stage_csv(base.filter(pr == "2-HIGH").select(*cols, "note"), f"{root}/05_upper.CSV")
    base.filter(pr == "5-LOW").select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("v")) \
        .write.mode("overwrite").text(f"{root}/06_notes.txt")
    I.stage_csv(base.filter(pr == "3-MEDIUM").select(*cols, "note", F.lit("10:11:12").alias("t")), f"{root}/07_time_only.csv")
    I.stage_csv(base.limit(0).select(*cols, "note", F.lit("10:11:12").alias("t")), f"{root}/08_header_only.csv")
    return root


def _uploaded(fx: Fixtures):
    """The drift set uploaded in name order into a fresh store."""
    folder = write_drift_set(fx)
    store = I.DatasetStore(fx.spark, scratch_path(fx.spark, "store"))
    reports = store.upload_many(DRIFT_DATASET, folder, now=UPLOAD_CLOCK)
    return store, folder, reports


def write_history_set(fx: Fixtures) -> str:
    spark = fx.spark
    root = scratch_path(spark, "history-set")
    ev = fx.events.withColumn("upload", F.when(F.dayofmonth("ts") == 30, F.lit("manual-import"))
                              .otherwise(F.date_format("ts", "yyyyMMdd_000000")))
    ev.write.partitionBy("upload").parquet(root)
    spark.range(1).select(F.lit("this is not a parquet file").alias("v")).write.mode("overwrite") \
        .text(f"{root}/upload=20240131_000000")
    return root


# What the drift set holds, by source -- which orders, whether it is taken, as what upload,
# with what columns, and what the report says.
_UPLOADED = """
v as (select * from (values
 ('01_base.csv', true, '20240201_090000', 6, true, '', ''),
 ('02_missing_amt.csv', false, null, 5, false, 'absent: amt', ''),
 ('03_extra_note.csv', true, '20240201_090002', 7, false, '', 'added: note'),
 ('04_amt_text.csv', false, null, 7, false, 'amt: VARCHAR where DOUBLE is stored', ''),
 ('05_upper.CSV', true, '20240201_090004', 7, false, '', ''),
 ('06_notes.txt', false, null, null, null, 'not a .csv source', ''),
 ('07_time_only.csv', true, '20240201_090006', 8, false, '', 'added: t'),
 ('08_header_only.csv', false, null, 8, false, 'amt: VARCHAR where DOUBLE is stored; d: VARCHAR where DATE is stored; flag: VARCHAR where BOOLEAN is stored; '
  || 'id: VARCHAR where BIGINT is stored; t: VARCHAR where TIME is stored; ts: VARCHAR where TIMESTAMP is stored', ''))
 as t(source, accepted, upload, n_columns, is_first_upload, errors, warnings)),
o as (select s.source, o_orderkey as id, o_orderpriority as name, o_totalprice as amt, o_orderstatus = 'F' as flag, cast(o_orderdate as date) as d,
  o_orderdate as ts, 'c' || o_custkey as note from orders
 join (values ('01_base.csv', 'F', null), ('02_missing_amt.csv', 'O', null), ('03_extra_note.csv', 'P', null), ('04_amt_text.csv', null, '1-URGENT'),
  ('05_upper.CSV', null, '2-HIGH'), ('07_time_only.csv', null, '3-MEDIUM')) as s(source, st, pr) on o_orderstatus = s.st or o_orderpriority = s.pr),
n as (select v.source, count(o.id) as rows from v left join o using (source) group by 1),
c as (select * from (values (0, 'id', 'BIGINT'), (1, 'name', 'VARCHAR'), (2, 'amt', 'DOUBLE'), (3, 'flag', 'BOOLEAN'), (4, 'd', 'DATE'), (5, 'ts', 'TIMESTAMP'),
  (6, 'note', 'VARCHAR'), (7, 't', 'TIME')) as t(ordinal, column_name, type))
"""

# Reports as text, for comparison.
_REPORT = ["dataset_id", "source", "accepted", "upload", "row_count", "n_columns", "is_first_upload"]


def _told(reports):
    return reports.select(*_REPORT, *[F.array_join(c, "; ").alias(c) for c in ("errors", "warnings")])


# ------------------------------------------------------------------ S1 - S5, S7, S8

@query("csv_gate", "with " + _UPLOADED + "select source, source <> '06_notes.txt' as accepted from v")
def csv_gate(fx: Fixtures):
    return I.list_drop_folder(fx.spark, write_drift_set(fx)).select("source", "accepted")


@query("csv_scan_infer", "with " + _UPLOADED + """
select source, cast(row_number() over (partition by source order by ordinal) - 1 as int) as ordinal, column_name,
 case when source like '08%' or (source like '04%' and column_name = 'amt') then 'VARCHAR' else type end as type, true as nullable, rows as row_count
from v join n using (source) cross join c
where n_columns is not null and (column_name <> 'amt' or source not like '02%') and (column_name <> 'note' or n_columns >= 7) and (column_name <> 't' or n_columns = 8)
""")
def csv_scan_infer(fx: Fixtures):
    folder = write_drift_set(fx)
    out = None
    for name in sorted(r["source"] for r in I.list_drop_folder(fx.spark, folder).filter("accepted").collect()):
        source = I.CsvSource(fx.spark, f"{folder}/{name}")
        found = source.schema().withColumns({"source": F.lit(name), "row_count": F.lit(source.row_count).cast("bigint")})
        out = found if out is None else out.unionByName(found)
    return out.select("source", "ordinal", "column_name", "type", "nullable", "row_count")


@query("csv_text_round_trip", """
select 'documents' as source, count(*) as rows, count(text) as texts, sum(length(text)) as chars, sum(length(text) - length(replace(text, chr(10), ''))) as breaks,
 cast(bit_xor(('0x' || substr(md5(text), 1, 15))::bigint) as bigint) as digest from documents
union all
select 'conversations', count(*), count(text), sum(length(text)), sum(length(text) - length(replace(text, chr(10), ''))),
 cast(bit_xor(('0x' || substr(md5(text), 1, 15))::bigint) as bigint) from conversations
""")
def csv_text_round_trip(fx: Fixtures):
    """S1 / S10 on model texts: exported, inferred, uploaded and read back."""
    out = None
    for name in ("documents", "conversations"):
        table = getattr(fx, name)
        path = I.export_rows(table, scratch_path(fx.spark, "texts") + f"/{name}.csv")
        store = I.DatasetStore(fx.spark, scratch_path(fx.spark, "texts-store"))
        store.upload_csv(name, path, now=UPLOAD_CLOCK)
        text = F.col("text")
        part = store.read_all(name).agg(
            F.count(F.lit(1)).alias("rows"), F.count(text).alias("texts"), F.sum(F.length(text)).alias("chars"),
            F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"),
            F.bit_xor(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")).alias("digest"))
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("upload_pipeline", """
select 'all_orders' as dataset_id, 'orders.csv' as source, true as accepted, '20240201_090000' as upload, count(*) as row_count, 6 as n_columns,
 true as is_first_upload, '' as errors, '' as warnings from orders
""")
def upload_pipeline(fx: Fixtures):
    path = I.stage_csv(fx.orders, scratch_path(fx.spark, "orders") + "/orders.csv")
    store = I.DatasetStore(fx.spark, scratch_path(fx.spark, "store"))
    rep = store.upload_csv("all_orders", path, now=UPLOAD_CLOCK)
    return _told(fx.spark.createDataFrame([rep], I.REPORT_SCHEMA))


@query("multi_file_upload", "with " + _UPLOADED + f"""
select '{DRIFT_DATASET}' as dataset_id, source, accepted, upload, case when accepted then rows end as row_count, n_columns, is_first_upload, errors, warnings
from v join n using (source)
""")
def multi_file_upload(fx: Fixtures):
    return _told(_uploaded(fx)[2])


@query("csv_to_parquet_append", "with " + _UPLOADED + """
select upload, count(*) as rows, cast(sum(id) as bigint) as ids, round(sum(amt), 2) as amt from v join o using (source) where accepted group by 1
""")
def csv_to_parquet_append(fx: Fixtures):
    store, _, _ = _uploaded(fx)
    return store.read_all(DRIFT_DATASET).groupBy("upload").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.round(F.sum("amt"), 2).alias("amt"))


@query("list_uploads", "with " + _UPLOADED + "select upload, true as stored from v where accepted")
def list_uploads(fx: Fixtures):
    store, _, _ = _uploaded(fx)
    return store.list_uploads(DRIFT_DATASET).groupBy("upload").agg((F.sum("file_size") > 0).alias("stored"))


@query("dataset_read_all", "with " + _UPLOADED + f"""
select id, name, amt, flag, strftime(d, '%Y-%m-%d') as d, {iso_sql('ts')} as ts, case when n_columns >= 7 then note end as note,
 case when n_columns = 8 then '10:11:12' end as t, upload from v join o using (source) where accepted
""")
def dataset_read_all(fx: Fixtures):
    store, _, _ = _uploaded(fx)
    rows = store.read_all(DRIFT_DATASET)
    return rows.select("id", "name", "amt", "flag", F.date_format("d", "yyyy-MM-dd").alias("d"), S.isoformat("ts").alias("ts"), "note", "t", "upload")


# ------------------------------------------------------------------ C1 - C8

_DUCK_CANON = """case data_type when 'INTEGER' then 'BIGINT' when 'BIGINT' then 'BIGINT' when 'DOUBLE' then 'DOUBLE'
 when 'VARCHAR' then 'VARCHAR' when 'TIMESTAMP' then 'TIMESTAMP' when 'BOOLEAN' then 'BOOLEAN' when 'DATE' then 'DATE'
 when 'FLOAT[]' then 'ARRAY<FLOAT>' else data_type end"""


@query("schema_describe", "with c as (" + " union all ".join(
    f"select '{t}' as table_name, count(*) as row_count from {t}" for t in BASE_TABLES) + f""")
select i.table_name, cast(i.ordinal_position - 1 as int) as ordinal, i.column_name, {_DUCK_CANON} as type, true as nullable, c.row_count
from information_schema.columns i join c on c.table_name = i.table_name
""")
def schema_describe(fx: Fixtures):
    frames = {t: getattr(fx.tables, t) for t in BASE_TABLES}
    columns = [(t, i, f.name, C.canonical_type(f.dataType), True) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    described = fx.spark.createDataFrame(columns, "table_name string, ordinal int, column_name string, type string, nullable boolean")
    return described.join(row_count(fx), "table_name").select("table_name", "ordinal", "column_name", "type", "nullable", "row_count")


@query("schema_drift", """
with c as (select * from (values ('id', 'BIGINT'), ('name', 'VARCHAR'), ('amt', 'DOUBLE'), ('flag', 'BOOLEAN'), ('d', 'DATE'), ('ts', 'TIMESTAMP'),
  ('note', null)) as t(column_name, old_type)),
s as (select * from (values ('02_missing_amt.csv'), ('03_extra_note.csv'), ('04_amt_text.csv')) as t(source)),
j as (select source, column_name, old_type, case when column_name = 'note' then 'VARCHAR' when column_name <> 'amt' then old_type
  when source like '02%' then null when source like '04%' then 'VARCHAR' else old_type end as new_type from c cross join s
 where column_name <> 'note' or source not like '02%')
select source, column_name, old_type, new_type, case when new_type is null then 'missing' when old_type is null then 'extra'
 when old_type <> new_type then 'type_mismatch' else 'ok' end as kind from j
""")
def schema_drift(fx: Fixtures):
    folder = write_drift_set(fx)
    old = I.CsvSource(fx.spark, f"{folder}/01_base.csv").schema()
    out = None
    for src in ("02_missing_amt.csv", "03_extra_note.csv", "04_amt_text.csv"):
        new = I.CsvSource(fx.spark, f"{folder}/{src}").schema()
        d = C.schema_drift(new, old).withColumn("source", F.lit(src))
        out = d if out is None else out.unionByName(d)
    return out


_STORED = """
select upload, ordinal, column_name, type, rows as row_count from v join n using (source) cross join c
where accepted and (column_name <> 'note' or n_columns >= 7) and (column_name <> 't' or n_columns = 8)
"""


@query("schema_store", "with " + _UPLOADED + f"select '{DRIFT_DATASET}' as dataset_id, s.* from ({_STORED}) s")
def schema_store(fx: Fixtures):
    store, _, _ = _uploaded(fx)
    return store.schemas().select("dataset_id", "upload", "ordinal", "column_name", "type", "row_count")


@query("schema_evolve", "with " + _UPLOADED + """
select source, accepted, upload, case when accepted then cast(n_columns as bigint) end as columns_in_force, errors, warnings from v
""")
def schema_evolve(fx: Fixtures):
    """C4: after each accepted upload its schema is the one the next upload
    must match -- the column count of the schema in force per upload."""
    store, _, reports = _uploaded(fx)
    n = store.schemas().groupBy("upload").agg(F.count(F.lit(1)).alias("columns_in_force"))
    return _told(reports).join(n, "upload", "left").select("source", "accepted", "upload", "columns_in_force", "errors", "warnings")


@query("total_rows_rollup", "with " + _UPLOADED + f"select '{DRIFT_DATASET}' as id, cast(sum(rows) as bigint) as total_rows from v join n using (source) where accepted")
def total_rows_rollup(fx: Fixtures):
    _, _, reports = _uploaded(fx)
    reg = fx.spark.createDataFrame([(DRIFT_DATASET, 0)], "id string, total_rows bigint")
    return R.total_rows_rollup(reg, reports)


@query("schema_with_total", "with " + _UPLOADED + f"""
select '{DRIFT_DATASET}' as dataset_id, ordinal, column_name, type, (select cast(sum(rows) as bigint) from v join n using (source) where accepted) as total_rows from c
""")
def schema_with_total(fx: Fixtures):
    store, _, reports = _uploaded(fx)
    reg = R.total_rows_rollup(fx.spark.createDataFrame([(DRIFT_DATASET, None)], "id string, total_rows bigint"), reports)
    return C.schema_with_total(store.schemas(), reg).select("dataset_id", "ordinal", "column_name", "type", "total_rows")


@query("schema_compare_versions", "with " + _UPLOADED + """
select column_name, case when ordinal < 6 then type end as old_type, type as new_type, case when ordinal < 6 then 'ok' else 'extra' end as kind from c
""")
def schema_compare_versions(fx: Fixtures):
    store, _, _ = _uploaded(fx)
    uploads = store.committed(DRIFT_DATASET)
    return C.compare_versions(store.schemas(), DRIFT_DATASET, uploads[0][1], uploads[-1][1])


_OVERRIDE = {"c_name": "bigint", "c_acctbal": "int", "c_mktsegment": "boolean"}


@query("schema_override", """
select 'c_name' as column_name, 'bigint' as type, count(*) filter (where c_name is not null and try_cast(c_name as bigint) is null) as cells_nulled from customer
union all select 'c_acctbal', 'int', count(*) filter (where c_acctbal is not null and try_cast(c_acctbal as int) is null) from customer
union all select 'c_mktsegment', 'boolean', count(*) filter (where c_mktsegment is not null and try_cast(c_mktsegment as boolean) is null) from customer
""")
def schema_override(fx: Fixtures):
    _, report = C.schema_override(fx.customer, _OVERRIDE)
    return report


# Fixed value: the shape of the fixture's responses.
_RESPONSE_SHAPE = "OBJECT<content: OBJECT<choices: ARRAY<OBJECT<text: STRING>>>, props: OBJECT<k: BIGINT>>"


@query("response_schema_detect", f"""
select '{_RESPONSE_SHAPE}' as schema, count(*) as responses from responses where json_type(response, '$.content.choices[0].text') = 'VARCHAR'
 and json_type(response, '$.props.k') in ('UBIGINT', 'BIGINT')
""", ["responses"])
def response_schema_detect(fx: Fixtures):
    n = fx.responses.agg(F.count(F.lit(1)))
    return C.response_schema(fx.responses, "response").withColumn("responses", n.scalar())


# ------------------------------------------------------------------ S6, S9 - S12, A1, A7

@query("parquet_scan", """
select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as revenue from lineitem where l_shipdate >= timestamp '1995-01-01' group by 1
""")
def parquet_scan(fx: Fixtures):
    li = fx.lineitem
    return (li.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
            .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")))


@query("registry_scan", """
select 'datasets' as registry, count(*) as live from reg_datasets where not is_deleted
union all select 'suites', count(*) from reg_suites where not is_deleted
union all select 'evaluations', count(*) from reg_evals where not is_deleted
""", ["reg_datasets", "reg_suites", "reg_evals"])
def registry_scan(fx: Fixtures):
    """Registries snapshotted to Parquet and scanned back (the file shape
    a JDBC export would have)."""
    out = None
    for name, df in (("datasets", fx.reg_datasets), ("suites", fx.reg_suites), ("evaluations", fx.reg_evals)):
        path = scratch_path(fx.spark, f"registry-{name}")
        df.write.parquet(path)
        n = R.live(fx.spark.read.parquet(path)).agg(F.count(F.lit(1)).alias("live")).withColumn("registry", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.select("registry", "live")


@query("export_rows", "select * from customer")
def export_rows(fx: Fixtures):
    path = I.export_rows(fx.customer, scratch_path(fx.spark, "export-csv"), "csv")
    return fx.spark.read.schema(fx.customer.schema).option("header", True).csv(path)


@query("export_rows_json", "select * from customer")
def export_rows_json(fx: Fixtures):
    path = I.export_rows(fx.customer, scratch_path(fx.spark, "export-json"), "json")
    return fx.spark.read.schema(fx.customer.schema).json(path)


@query("csv_delimiter", f"""
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, {iso_sql('o_orderdate')} as o_orderdate, o_orderpriority from orders
""")
def csv_delimiter(fx: Fixtures):
    path = I.stage_csv(fx.orders, scratch_path(fx.spark, "pipe-csv"), sep="|")
    df, _, _ = I.infer_csv(fx.spark, path, sep="|")
    return df.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus",
                     F.col("o_totalprice").cast("double"), S.isoformat("o_orderdate").alias("o_orderdate"),
                     "o_orderpriority")


@query("run_tables_sink", f"""
select row_id, run_id, batch_id, {iso_sql('ts')} as ts, status_code, response_time_ms, payload, strftime(ts, '%Y-%m-%d') as day from run_outputs
""", ["run_outputs"])
def run_tables_sink(fx: Fixtures):
    out = fx.run_outputs.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = I.write_run_table(out, scratch_path(fx.spark, "run-outputs"), "run_id", ["ts"], "day")
    back = fx.spark.read.parquet(path)
    return back.select("row_id", "run_id", "batch_id", S.isoformat("ts").alias("ts"), "status_code",
                       "response_time_ms", "payload", F.col("day").cast("string").alias("day"))


@query("run_inputs_sink", """
select doc_id as row_id, doc_id % 5 as run_id, text as input, lang as groundtruth, source as part from documents
""")
def run_inputs_sink(fx: Fixtures):
    rows = fx.documents.select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 5).alias("run_id"), F.col("text").alias("input"),
                               F.col("lang").alias("groundtruth"), F.col("source").alias("part"))
    path = I.write_run_table(rows, scratch_path(fx.spark, "run-inputs"), "run_id", ["row_id"], "part")
    return fx.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("run_metrics_sink", """
select l_linenumber as run_id, 'accuracy' as metric_name, round(avg(cast(y_true = y_pred as double)), 6) as metric_value from pred_class group by 1
union all select l_linenumber, 'mae', round(avg(abs(y_true - y_pred)), 4) from pred_reg group by 1
""", ["pred_class", "pred_reg"])
def run_metrics_sink(fx: Fixtures):
    run = lambda df: df.withColumnRenamed("l_linenumber", "run_id")
    rows = M.run_metrics(run(fx.pred_class), ["accuracy"], "run_id").unionByName(M.run_metrics(run(fx.pred_reg), ["mae"], "run_id"))
    path = I.write_run_table(rows, scratch_path(fx.spark, "run-metrics"), "run_id", ["metric_value"], "metric_name")
    digits = F.when(F.col("metric_name") == "mae", F.round("metric_value", 4)).otherwise(F.round("metric_value", 6))
    return fx.spark.read.schema(rows.schema).parquet(path).select("run_id", "metric_name", digits.alias("metric_value"))


@query("row_count", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in BASE_TABLES))
def row_count(fx: Fixtures):
    out = None
    for t in BASE_TABLES:
        c = getattr(fx.tables, t).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out.select("table_name", "row_count")


@query("dataset_profile", " union all ".join(
    f"select {i} as ordinal, '{c}' as column_name, '{t}' as type, count({c}) as non_null, cast(min({c}) as varchar) as min, "
    f"cast(max({c}) as varchar) as max, count(*) as rows from customer"
    for i, (c, t) in enumerate([("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "BIGINT"),
                                ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR")])))
def dataset_profile(fx: Fixtures):
    return C.profile(fx.customer).drop("approx_distinct", "samples")


@query("profile_samples", " union all ".join(
    f"select '{c}' as column_name, array_to_string(list_sort(list_distinct([{', '.join(f"arg_min({c}::varchar, md5('{k}:' || {c}::varchar))" for k in range(3))}])), '; ') as samples from customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def profile_samples(fx: Fixtures):
    return C.profile(fx.customer.drop("c_acctbal")).select("column_name", F.array_join("samples", "; ").alias("samples"))


# ------------------------------------------------------------------ W1, L2, V9

_HISTORY_SQL = f"""
with e as (select case when day(ts) = 30 then 'manual-import' else strftime(ts, '%Y%m%d_000000') end as upload from events),
u as (select upload, count(*) as rows_added from e group by 1)
select case when regexp_matches(upload, '^[0-9]{{8}}_[0-9]{{6}}$') and try_strptime(upload, '%Y%m%d_%H%M%S') is not null
  then {iso_sql("try_strptime(upload, '%Y%m%d_%H%M%S')")} else upload end as timestamp, upload as filename, rows_added,
 sum(rows_added) over (order by upload rows between unbounded preceding and current row) as cumulative_rows from u
"""


@query("dataset_history", f"select timestamp, filename, rows_added, cast(cumulative_rows as bigint) as cumulative_rows, true as bytes_known from ({_HISTORY_SQL}) order by filename")
def dataset_history(fx: Fixtures):
    h = I.dataset_history(fx.spark, write_history_set(fx))
    known = (F.col("file_size_bytes") > 0) & (F.col("cumulative_file_size_bytes") >= F.col("file_size_bytes"))
    return h.select("timestamp", "filename", "rows_added", F.col("cumulative_rows").cast("bigint").alias("cumulative_rows"), known.alias("bytes_known"))


@query("dataset_history_counts", _HISTORY_SQL)
def dataset_history_counts(fx: Fixtures):
    return I.dataset_history(fx.spark, write_history_set(fx)).select(
        "timestamp", "filename", "rows_added", F.col("cumulative_rows").cast("bigint").alias("cumulative_rows"))


@query("preview", f"""
with d as (select * from events where strftime(ts, '%Y%m%d') = '20240101')
select event_id, {iso_sql('ts')} as ts, user_id, event_type, value, props, (select count(*) from d) as file_row_count, '20240101_000000' as upload
from d order by event_id limit 10
""")
def preview(fx: Fixtures):
    return I.preview(fx.spark, write_history_set(fx), 10)


@query("preview_chosen", f"""
with d as (select * from events where strftime(ts, '%Y%m%d') = '20240115')
select event_id, {iso_sql('ts')} as ts, user_id, event_type, value, props, (select count(*) from d) as file_row_count, '20240115_000000' as upload
from d order by event_id limit 5
""")
def preview_chosen(fx: Fixtures):
    return I.preview(fx.spark, write_history_set(fx), 5, upload="20240115_000000")


# Limits that some pages and sites exceed: characters of a page, of all pages of a group.
_PAGE_LIMIT, _GROUP_LIMIT = 2_000, 60_000


@query("check_upload_size", f"""
with l as (select page_id % 7 as dataset_id, cast(page_id as varchar) as file_name, length(html) as file_size from pages)
select dataset_id, file_name as id, 'file_too_large' as rule from l where file_size > {_PAGE_LIMIT}
union all select dataset_id, cast(dataset_id as varchar), 'dataset_too_large' from l group by 1 having sum(file_size) > {_GROUP_LIMIT}
""")
def check_upload_size(fx: Fixtures):
    """V9 over a listing from a table: each page a file, its characters its size."""
    listing = fx.pages.select((F.col("page_id") % 7).alias("dataset_id"), F.col("page_id").cast("string").alias("file_name"),
                              F.length("html").alias("file_size"))
    return I.check_upload_size(listing, _PAGE_LIMIT, _GROUP_LIMIT)


# ------------------------------------------------------------------ U1 - U3

def _columns(df):
    """(column_name, cells): the columns of a table and their non-null cells."""
    cells = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
    return cells.unpivot([], df.columns, "column_name", "cells")


_CELLS = " union all ".join(f"select '{t}' as t, '{c}' as column_name, count({c}) as cells from {t}" for t, cols in
                            (("documents", ("doc_id", "text", "lang", "source", "n_chars")), ("benchmark", ("item_id", "text"))) for c in cols)


@query("column_set_diff", f"""
with c as ({_CELLS}), o as (select column_name, cells from c where t = 'documents'), n as (select column_name, cells from c where t = 'benchmark')
select coalesce(o.column_name, n.column_name) as column_name, case when n.column_name is null then 'missing' when o.column_name is null then 'extra'
 else 'common' end as kind, o.cells as old_cells, n.cells as new_cells from o full join n on o.column_name = n.column_name
""")
def column_set_diff(fx: Fixtures):
    """U1 with the cells that a missing or extra column takes or brings."""
    old = _columns(fx.documents).select("column_name", F.col("cells").alias("old_cells"))
    new = _columns(fx.benchmark).select("column_name", F.col("cells").alias("new_cells"))
    kind = F.when(F.col("new_cells").isNull(), "missing").when(F.col("old_cells").isNull(), "extra").otherwise("common")
    return old.join(new, "column_name", "full").select("column_name", kind.alias("kind"), "old_cells", "new_cells")


@query("subset_check", f"""
with h as (select table_name, count(*) filter (where column_name in ('text', 'lang')) as have from information_schema.columns
  where table_name in ({", ".join(f"'{t}'" for t in BASE_TABLES)}) group by 1),
n as ({" union all ".join(f"select '{t}' as table_name, count(*) as rows from {t}" for t in BASE_TABLES)})
select table_name, have = 2 as ok, 2 - have as n_missing, case when have = 2 then rows else 0 end as usable_rows from h join n using (table_name)
""")
def subset_check(fx: Fixtures):
    """Which tables hold the wanted columns, and how many rows they offer."""
    want = F.array(F.lit("text"), F.lit("lang"))
    rows = [(t, getattr(fx.tables, t).columns) for t in BASE_TABLES]
    have = fx.spark.createDataFrame(rows, "table_name string, cols array<string>").join(row_count(fx), "table_name")
    missing = F.size(F.array_except(want, F.col("cols")))
    return have.select("table_name", (missing == 0).alias("ok"), missing.cast("bigint").alias("n_missing"),
                       F.when(missing == 0, F.col("row_count")).otherwise(0).alias("usable_rows"))


@query("union_uploads", """
select doc_id, text, lang, source, n_chars, null::bigint as item_id from documents
union all select null, text, null, null, null, item_id from benchmark
""")
def union_uploads(fx: Fixtures):
    return fx.documents.unionByName(fx.benchmark, allowMissingColumns=True) \
        .select("doc_id", "text", "lang", "source", "n_chars", "item_id")


@query("dataset_growth_uploads", """
with per as (select strftime(ts, '%Y-%m-%d') as period, count(*) as rows_added from events group by 1)
select 'events_history' as dataset_id, period, rows_added,
 cast(sum(rows_added) over (order by period rows between unbounded preceding and current row) as bigint) as cumulative_rows, cast(1 as bigint) as files_left_out from per
""")
def dataset_growth_uploads(fx: Fixtures):
    """W5 over stored uploads: rows per upload day of the history set, and how many damaged files were left out."""
    from vellum.operators import runs as RU
    folder = write_history_set(fx)
    left_out = I.file_rows(fx.spark, folder).filter("damaged").count()
    data = fx.spark.read.option("ignoreCorruptFiles", True).parquet(folder)
    g = RU.dataset_growth(data.withColumn("dataset_id", F.lit("events_history")), "dataset_id", "ts")
    return g.select("dataset_id", F.date_format("period", "yyyy-MM-dd").alias("period"), "rows_added",
                    F.col("cumulative_rows").cast("bigint").alias("cumulative_rows"), F.lit(left_out).cast("bigint").alias("files_left_out"))


@query("damaged_files", "select '20240131_000000' as upload, cast(1 as bigint) as files, (select count(*) from events) as rows_of_others")
def damaged_files(fx: Fixtures):
    """Stored files that can't be read, by upload, beside the rows of those that can."""
    files = I.file_rows(fx.spark, write_history_set(fx))
    rows = files.agg(F.sum("rows")).first()[0]
    return files.filter("damaged").groupBy("upload").agg(F.count(F.lit(1)).alias("files")).withColumn("rows_of_others", F.lit(rows).cast("bigint"))
