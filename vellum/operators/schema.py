"""Schema operators: describe, drift check, evolution, overrides, detection.

A schema is held as a small table ``(ordinal, column_name, type, nullable)``
made from a DataFrame's schema (metadata only -- no data passes the driver).
Drift between two schema tables is a full outer join on the column name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical type names (engine- and file-size-independent).
CANONICAL = {
    "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT",
    "float": "DOUBLE", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}

SCHEMA_TABLE = "ordinal int, column_name string, type string, nullable boolean"


def canonical_type(dt: T.DataType) -> str:
    name = dt.simpleString()
    if name in CANONICAL:
        return CANONICAL[name]
    if name.startswith("decimal"):
        return "DECIMAL"
    return name.upper()


def schema_table(spark: SparkSession, schema: T.StructType, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per column.  ``overrides`` replaces canonical type names
    (e.g. time-only columns read as text but reported as TIME)."""
    overrides = overrides or {}
    rows = [(i, f.name, overrides.get(f.name, canonical_type(f.dataType)), True)
            for i, f in enumerate(schema.fields)]
    # a CSV-derived table is always nullable, as DESCRIBE of a CTAS reports
    # one row per column: a single partition, not one task per core
    return spark.createDataFrame(rows, SCHEMA_TABLE).coalesce(1)


def schema_drift(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Per column: missing (error), extra (warning), type_mismatch
    (error) or ok.  No previous schema -> every column is ok.  Column names
    are unique within a schema table."""
    if old is None:
        return new.select("column_name", F.lit(None).cast("string").alias("old_type"),
                          F.col("type").alias("new_type"), F.lit("ok").alias("kind"))
    # a full outer match on the column name, written as one grouped union
    # (one shuffle) rather than a join (two)
    n = new.select("column_name", F.lit(None).cast("string").alias("old_type"), F.col("type").alias("new_type"))
    o = old.select("column_name", F.col("type").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    j = o.unionByName(n).groupBy("column_name").agg(F.max("old_type").alias("old_type"),
                                                    F.max("new_type").alias("new_type"))
    kind = (F.when(F.col("new_type").isNull(), F.lit("missing"))
            .when(F.col("old_type").isNull(), F.lit("extra"))
            .when(F.col("old_type") != F.col("new_type"), F.lit("type_mismatch"))
            .otherwise(F.lit("ok")))
    return j.select("column_name", "old_type", "new_type", kind.alias("kind"))


def drift_verdict(drift: DataFrame) -> DataFrame:
    """C3 verdict: valid, error and warning texts (column lists sorted)."""
    names = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("column_name"))))
    mism = F.array_sort(F.collect_list(F.when(
        F.col("kind") == "type_mismatch",
        F.concat(F.col("column_name"), F.lit(": "), F.col("new_type"), F.lit(" where "), F.col("old_type"), F.lit(" is stored")))))
    agg = drift.agg(names("missing").alias("missing"), names("extra").alias("extra"), mism.alias("mismatch"))
    errors = F.concat(
        F.when(F.size("missing") > 0, F.array(F.concat(F.lit("absent: "), F.array_join("missing", ", "))))
        .otherwise(F.array().cast("array<string>")),
        F.col("mismatch"))
    warnings = F.when(F.size("extra") > 0, F.array(F.concat(F.lit("added: "), F.array_join("extra", ", ")))) \
        .otherwise(F.array().cast("array<string>"))
    return agg.select((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def drift_lists(new: dict[str, str], old: dict[str, str] | None) -> tuple[list[str], list[str]]:
    """C3 verdict of two column -> type mappings: the errors and warnings that
    ``drift_verdict`` gives for the same schemas."""
    if old is None:
        return [], []
    absent, added = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    changed = sorted(f"{c}: {new[c]} where {old[c]} is stored" for c in old if c in new and new[c] != old[c])
    return ([f"absent: {', '.join(absent)}"] if absent else []) + changed, [f"added: {', '.join(added)}"] if added else []


def compare_versions(schemas: DataFrame, dataset_id, version_a: str, version_b: str) -> DataFrame:
    """Drift between two stored versions of one dataset's schema."""
    pick = lambda v: schemas.filter((F.col("dataset_id") == dataset_id) & (F.col("upload") == v))
    return schema_drift(pick(version_b), pick(version_a))


def current_schema(schemas: DataFrame) -> DataFrame:
    """The latest stored schema per dataset, by the upload's number."""
    latest = schemas.groupBy("dataset_id").agg(F.max("seq").alias("seq"))
    return schemas.join(latest, ["dataset_id", "seq"], "left_semi")


def schema_with_total(schemas: DataFrame, registry: DataFrame) -> DataFrame:
    """Current schema with total_rows from the registry (null -> 0)."""
    reg = registry.select(F.col("id").alias("dataset_id"), F.coalesce("total_rows", F.lit(0)).cast("bigint").alias("total_rows"))
    return current_schema(schemas).join(reg, "dataset_id", "left") \
        .withColumn("total_rows", F.coalesce("total_rows", F.lit(0)).cast("bigint"))


def schema_override(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast columns to the given types with ``try_cast``; returns the cast
    frame and a report (column_name, type, cells_nulled) counting values
    that did not survive the cast -- one aggregate pass."""
    cast = df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    lost = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()]
    rep = df.agg(*lost)
    report = rep.unpivot([], list(types), "column_name", "cells_nulled") \
        .withColumn("type", F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])[F.col("column_name")])
    return cast, report.select("column_name", "type", "cells_nulled")


def response_schema(df: DataFrame, response_col: str, group: list[str] = ()) -> DataFrame:
    """The merged schema of JSON responses (one aggregate)."""
    return df.groupBy(*group).agg(F.schema_of_variant_agg(F.try_parse_json(F.col(response_col))).alias("schema"))


SAMPLES = 3


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null, min, max (as text), an approximate
    distinct count and sample values (the distinct ones whose text has the
    smallest digest under ``SAMPLES`` salts) -- one aggregate pass over all columns,
    then unpivoted."""
    cols = df.columns
    drawn = lambda c, k: F.min_by(F.col(c).cast("string"), F.md5(F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).cast("binary")))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"nn{i}"), F.min(c).cast("string").alias(f"mn{i}"),
                 F.max(c).cast("string").alias(f"mx{i}"), F.approx_count_distinct(c).alias(f"ad{i}"),
                 F.array_sort(F.array_distinct(F.array_compact(F.array(*[drawn(c, k) for k in range(SAMPLES)])))).alias(f"sv{i}")]
    row = df.agg(*aggs)
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                                       F.lit(canonical_type(df.schema[c].dataType)).alias("type"),
                                       F.col(f"nn{i}").alias("non_null"), F.col(f"mn{i}").alias("min"),
                                       F.col(f"mx{i}").alias("max"), F.col(f"ad{i}").alias("approx_distinct"),
                                       F.col(f"sv{i}").alias("samples"))
                              for i, c in enumerate(cols)])).alias("p")
    return row.select(F.col("_rows").alias("rows"), per).select("p.*", "rows")


# The schema of a dataset as a JSON document: {"dataset_id": ..., "version": ..., "columns": [{"name", "type", "nullable"}, ...]}.
DOCUMENT = "dataset_id string, version string, columns array<struct<name string, type string, nullable boolean>>"


def schema_documents(schemas: DataFrame) -> DataFrame:
    """(dataset_id, upload, document): each stored version of a schema as a JSON document, columns in their order."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "type", "nullable"))), lambda c: F.struct(
        c["column_name"].alias("name"), c["type"].alias("type"), c["nullable"].alias("nullable")))
    return schemas.groupBy("dataset_id", "upload").agg(columns.alias("columns")).select(
        "dataset_id", "upload", F.to_json(F.struct(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("upload").cast("string").alias("version"), "columns")).alias("document"))


def load_schema_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """The schema table of JSON documents: (dataset_id, upload, ordinal, column_name, type, nullable), the
    reverse of ``schema_documents``.  A text that isn't such a document gives no rows."""
    parsed = documents.select(F.from_json(F.col(document), DOCUMENT).alias("d"))
    each = parsed.select(F.col("d.dataset_id").alias("dataset_id"), F.col("d.version").alias("upload"), F.posexplode("d.columns").alias("ordinal", "c"))
    return each.filter("c.name is not null").select("dataset_id", "upload", "ordinal", F.col("c.name").alias("column_name"), F.col("c.type").alias("type"),
                                                    F.coalesce("c.nullable", F.lit(True)).alias("nullable"))
