"""Bulk data-quality checks.

The reference raises on the first bad field of one record; here every check
runs over a whole table and returns the violations as rows
``(id, rule)`` -- one row per failing record and rule, so a table of any size
is validated in one distributed pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import scalar as S

# Limits of the registry fields.
NAME_MAX = 255
DESCRIPTION_MAX = 10_000
METADATA_MAX = 100_000

# Allowed name characters (letters, digits, whitespace, '-', '_').
NAME_CLASS = "a-zA-Z0-9" + S.PY_WHITESPACE + r"\-_"
NAME_PATTERN = f"^[{NAME_CLASS}]+$"

HEX32 = "^[0-9a-fA-F]{32}$"
INTEGER_TEXT = "^[+-]?[0-9]+$"


def _violations(df: DataFrame, id_col: str, rule: Column) -> DataFrame:
    return (df.select(F.col(id_col).alias("id"), rule.alias("rule"))
            .filter(F.col("rule").isNotNull()))


def name_rule(name: Column) -> Column:
    """V1: first failing rule of a name, null when valid."""
    return (F.when(name.isNull() | (name == ""), F.lit("name_missing"))
            .when(S.strip(name) == "", F.lit("name_blank"))
            .when(F.length(name) > NAME_MAX, F.lit("name_too_long"))
            .when(~name.rlike(NAME_PATTERN), F.lit("name_invalid_chars")))


def check_name(df: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    return _violations(df, id_col, name_rule(F.col(name_col)))


def check_description(df: DataFrame, id_col: str = "id", col: str = "description") -> DataFrame:
    """V2: null or at most 10 000 characters."""
    c = F.col(col)
    return _violations(df, id_col, F.when(c.isNotNull() & (F.length(c) > DESCRIPTION_MAX),
                                          F.lit("description_too_long")))


def escaped_length(text: Column) -> Column:
    """Characters of the text with every non-ASCII one written as a JSON escape:
    6 each, 12 beyond the basic plane."""
    extra = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    beyond = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + 5 * extra + 6 * beyond


def too_long(text: Column, most: int = METADATA_MAX) -> Column:
    """Whether the escaped text has more than ``most`` characters.  Each byte beyond one a character
    stands for at most 5 more in the escaped text, so nearly all texts are told by their two lengths."""
    n, beyond = F.length(text), F.octet_length(text) - F.length(text)
    return F.when(n > most, True).when(n + 5 * beyond <= most, False).otherwise(escaped_length(text) > most)


def metadata_rule(m: Column) -> Column:
    """V3: a JSON object whose ASCII-escaped text is at most 100 000 characters.

    The text is parsed once: the schema of the parsed value is null for text
    that isn't JSON and tells objects from the rest."""
    kind = F.schema_of_variant(F.try_parse_json(m))
    return F.when(m.isNotNull(), F.transform(F.array(F.struct(kind.alias("k"))), lambda x: (
        F.when(x["k"].isNull(), F.lit("metadata_not_json"))
        .when(~x["k"].startswith("OBJECT"), F.lit("metadata_not_object"))
        .when(too_long(m), F.lit("metadata_too_long")))))


def check_metadata(df: DataFrame, id_col: str = "id", col: str = "metadata") -> DataFrame:
    # a generator: the filter on the rule can't be pushed below it with a copy of the parse
    rows = df.select(F.col(id_col).alias("id"), F.explode(metadata_rule(F.col(col))).alias("rule"))
    return rows.filter(F.col("rule").isNotNull())


def check_counts(df: DataFrame, cols: list[str], id_col: str = "id") -> DataFrame:
    """V4: every counter parses as an integer and is >= 0 (one row per bad column)."""
    rules = []
    for c in cols:
        v = F.trim(F.col(c).cast("string"))
        parsed = v.try_cast("bigint")
        rules.append(F.when(v.isNull(), F.lit(None))
                     .when(~v.rlike(INTEGER_TEXT) | parsed.isNull(), F.lit(f"{c}_not_integer"))
                     .when(parsed < 0, F.lit(f"{c}_negative")))
    # all columns in one pass over the table
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(*rules)).alias("rule"))
    return rows.filter(F.col("rule").isNotNull())


def uuid_hex(x: Column) -> Column:
    """The 32 hex digits Python's ``UUID()`` reads from a string: ``urn:`` and
    ``uuid:`` removed, braces stripped, hyphens dropped."""
    s = F.replace(F.replace(x, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    s = F.btrim(s, F.lit("{}"))
    return F.replace(s, F.lit("-"), F.lit(""))


def check_uuid(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """V5: the value parses as a UUID."""
    c = F.col(col)
    return _violations(df, id_col, F.when(c.isNotNull() & ~uuid_hex(c).rlike(HEX32), F.lit("not_uuid")))


def check_unique_name(df: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """V6: names held by more than one live row.

    Counting by name is a partial (map-side) aggregate, so a name held by a
    third of the rows costs no single hot task; the duplicated names are
    joined back (AQE broadcasts a small side by its bytes at run time and
    splits skewed partitions of a shuffle join).
    """
    rows = df.filter(~F.col("is_deleted")) if "is_deleted" in df.columns else df
    dups = (rows.groupBy(name_col).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1).select(name_col))
    return (rows.join(dups, name_col, "left_semi")
            .select(F.col(id_col).alias("id"), F.lit("name_not_unique").alias("rule")))


def check_status(df: DataFrame, allowed: list[str], id_col: str = "id", col: str = "status") -> DataFrame:
    """V7: status inside the enum's value set."""
    c = F.col(col)
    return _violations(df, id_col, F.when(c.isNull() | ~c.isin(*allowed), F.lit("status_invalid")))


def check_references(child: DataFrame, fk: str, parent: DataFrame, rule_prefix: str,
                     id_col: str = "id") -> DataFrame:
    """V8: a foreign key must name an existing parent row; a soft-deleted
    parent is reported separately.  Null keys are not checked."""
    p = parent.select(F.col("id").alias("_pid"), F.col("is_deleted").alias("_pdel")).distinct()
    j = child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pid"), "left")
    rule = (F.when(F.col("_pid").isNull(), F.lit(f"{rule_prefix}_missing"))
            .when(F.col("_pdel"), F.lit(f"{rule_prefix}_deleted")))
    return _violations(j, id_col, rule)
