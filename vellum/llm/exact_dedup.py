"""Exact dedup by progressive refinement, in DataFrame functions only.

1. Rows are counted by length in bytes, with map-side combine; lengths that occur once drop out.
2. Rows of the lengths left are counted by (length, hash of the first characters); pairs that
   occur once drop out.  The keys that survive a stage become a bit table (``mark_keys``).
3. Whole texts are hashed of the rows that the second table marks only
   (a row that shares a bit by chance is merely hashed for nothing).  Equal full
   hashes form a group; the largest id of each stays.

Texts of rows that dropped out are never hashed whole nor shuffled.

Defined cases: a null text counts as empty, so null and empty texts form one
group.  A null id ranks below every other.  Rows that repeat both id and text
are one document in several rows: all count in ``group_size``, one is kept.  An
empty table gives an empty result.  Other columns are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, lower_ascii, mark_keys, repeated, saved, with_group

PREFIX_CHARS = 256


def _norm(text: str) -> Column:
    return F.coalesce(lower_ascii(F.col(text)), F.lit(""))


def _length(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")


def _prefix(text: str, prefix_chars: int) -> Column:
    return F.xxhash64(lower_ascii(F.substring(F.coalesce(F.col(text), F.lit("")), 1, prefix_chars)))


def surviving(docs: DataFrame, text: str, name: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with the boolean ``name``: whether another row may have an equal text.

    Stage 1 counts lengths; stage 2 hashes the prefixes of rows whose length somebody shares, and
    counts (length, prefix).  Both keep their surviving keys only."""
    length, long_enough = fresh(docs, "length", "shares_length")
    lengths = saved(docs.select(_length(text).alias("n_bytes")).groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("n_bytes"), "exact-lengths")
    rows = mark_keys(docs.withColumn(length, _length(text)), lengths, long_enough, [F.col("n_bytes")], F.col(length))
    prefix, = fresh(rows, "prefix")
    rows = rows.withColumn(prefix, F.when(F.col(long_enough), _prefix(text, prefix_chars)))
    shared = saved(rows.filter(F.col(prefix).isNotNull()).groupBy(F.col(length).alias("n_bytes"), F.col(prefix).alias("prefix"))
                   .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("n_bytes", "prefix"), "exact-prefixes")
    marks, = fresh(rows, "marks")
    rows = mark_keys(rows, shared, marks, [F.col("n_bytes"), F.col("prefix")], F.col(length), F.col(prefix))
    keep = F.col(long_enough) & F.col(marks)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], keep.alias(name))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``;
    with ``digest`` also ``text_sha256``, which then is taken of every row."""
    slim = surviving(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "survives", prefix_chars)
    full = F.sha2(_norm("text"), 256)
    slim = saved(slim.select("doc_id", "survives",
                             F.unhex(full if digest else F.when(F.col("survives"), full)).alias("sha")), "exact-rows")
    rows = slim.filter("survives").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("rows"))
    groups = rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = saved(groups, "exact-groups")
    found = repeated(with_group(rows, groups, "sha", "group_size", slim.count()), "rows", "copy")
    found = found.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "sha")
    alone = slim.filter("not survives").select("doc_id", F.col("doc_id").alias("keep_id"),
                                               F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = found.unionByName(alone)
    return out.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha") if digest else out.drop("sha")


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Rows whose (length, prefix) nobody shares pass straight from the scan; only
    the others are shuffled.
    """
    survives, key, nth = fresh(docs, "survives", "row_key", "nth")
    rows = surviving(docs, text, survives, prefix_chars)
    row_key = F.concat_ws(":", F.sha2(_norm(text), 256), F.col(doc_id).cast("string"))
    shared = rows.filter(F.col(survives)).withColumn(key, row_key)
    slim = shared.select(F.col(doc_id).alias("id"), F.substring_index(F.col(key), ":", 1).alias("sha"))
    keepers = slim.groupBy("sha").agg(F.max("id").alias("id"))
    keepers = saved(keepers.select(F.concat_ws(":", "sha", F.col("id").cast("string")).alias(key)), "exact-keepers")
    one = Window.partitionBy(key).orderBy(F.lit(1))
    best = (shared.join(keepers, key, "left_semi")
            .withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1))
    return rows.filter(~F.col(survives)).select(*docs.columns).unionByName(best.select(*docs.columns))
