"""Replay of config and change logs by segments (K1-K4, R1, W2): new operations are applied to a stored state, and
segments that were summarised on their own compose to what the whole log gives.

What a segment of a suite's config log does to the pointer pair (latest, current) is a function with a small
description: the number of its saves, how many rollbacks it has by the latest version they need (a rollback
to ``t`` after ``k`` saves of the segment needs a latest of ``t - k`` before it), and, of the operations that may
set the current version last, the chain of those that an earlier one could not replace: from the segment's
end backwards each rollback that needs less than all after it, down to the last save.  Descriptions compose
associatively: the second one's needs shift by the first one's saves.

A record's change log is the same: whether it was live, its generation, and the last value of each
field since its last creation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.config import registry_current, replay_changes
from vellum.plans.prefix import prefix_sums

# ------------------------------------------------------------- config log

SUMMARY = "struct<saves: bigint, needs: array<struct<need: bigint, n: bigint>>, chain: array<struct<need: bigint, version: bigint, saved: boolean>>, refused: bigint>"


def segment_summaries(log: DataFrame, segment: str | None = None, suite: str = "suite_id", seq: str = "seq", op: str = "op", target: str = "target") -> DataFrame:
    """(suite_id, [segment,] summary): what each segment of the log does, whatever the state before it.

    ``needs`` counts rollbacks by the latest version they need (below zero: always refused, counted in ``refused``);
    ``chain`` holds the operations that may set the current version last, the last first: ``version`` counts from the latest
    version before the segment for a save and from 0 for a rollback."""
    keys = ["suite_id", *(["segment"] if segment else [])]
    base = log.select(F.col(suite).alias("suite_id"), *([F.col(segment).alias("segment")] if segment else []), F.col(seq).alias("seq"), F.col(op).alias("op"),
                      F.col(target).cast("long").alias("target"), (F.col(op) == "save").cast("long").alias("is_save"))
    ran = prefix_sums(base, ["seq"], ["is_save"], group_cols=keys).select(*keys, "seq", "op", "target", F.col("is_save_cum").alias("k"), F.col("is_save_total").alias("saves"))
    valid = (F.col("op") == "rollback") & (F.col("target") >= 0)
    need = F.when(valid, F.greatest(F.col("target") - F.col("k"), F.lit(0)))
    ran = ran.withColumn("need", need)
    needs = ran.filter("need is not null").groupBy(*keys, "need").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("need", "n"))).alias("needs"))
    # After the last save the version a rollback needs is its own less all saves: one row per needed version, its last place.
    tail = ran.filter((F.col("k") == F.col("saves")) & F.col("need").isNotNull()).groupBy(*keys, "need").agg(
        F.max_by("target", "seq").alias("version"), F.max("seq").alias("seq"))
    later = Window.partitionBy(*keys).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = tail.withColumn("least", F.min("need").over(later)).filter(F.col("least").isNull() | (F.col("need") < F.col("least")))
    chain = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "need", "version")), asc=False).alias("c"))
    sums = ran.groupBy(*keys).agg(F.max("saves").alias("saves"), F.count_if((F.col("op") != "save") & F.col("need").isNull()).alias("refused"))
    one = lambda need, version, saved: F.struct(need.alias("need"), version.alias("version"), F.lit(saved).alias("saved"))
    rolled = F.transform(F.coalesce("c", F.expr("array()")), lambda x: one(x["need"], x["version"], False))
    whole = F.when(F.col("saves") > 0, F.concat(rolled, F.array(one(F.lit(0).cast("long"), F.col("saves"), True)))).otherwise(rolled)
    match = lambda left, right: left.join(right.select(*[F.col(k).alias(f"_{k}") for k in keys], right.columns[-1]),
                                          [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    out = match(match(sums, needs), chain)
    empty = F.expr("cast(array() as array<struct<need: bigint, n: bigint>>)")
    return out.select(*keys, F.struct("saves", F.coalesce("needs", empty).alias("needs"), whole.alias("chain"), "refused").cast(SUMMARY).alias("summary"))


def compose(a: Column, b: Column) -> Column:
    """The summary of a segment ``a`` and the one after it."""
    s = a["saves"]
    shifted = F.transform(b["needs"], lambda x: F.struct(F.greatest(x["need"] - s, F.lit(0)).alias("need"), x["n"].alias("n")))
    # the chain goes on into the first segment unless the second one sets the version in any case
    moved = F.transform(b["chain"], lambda x: F.struct(F.when(x["saved"], x["need"]).otherwise(F.greatest(x["need"] - s, F.lit(0))).alias("need"),
                                                       F.when(x["saved"], x["version"] + s).otherwise(x["version"]).alias("version"), x["saved"].alias("saved")))
    least = F.coalesce(F.array_min(F.transform(moved, lambda x: x["need"])), F.lit(2 ** 62).cast("long"))
    rest = F.filter(a["chain"], lambda x: x["need"] < least)
    return F.struct((s + b["saves"]).alias("saves"), F.concat(a["needs"], shifted).alias("needs"), F.concat(moved, rest).alias("chain"),
                    (a["refused"] + b["refused"]).alias("refused")).cast(SUMMARY)


def compose_segments(summaries: DataFrame) -> DataFrame:
    """(suite_id, summary) of all segments of each suite, in the order of ``segment``."""
    zero = F.expr(f"cast(struct(0, array(), array(), 0) as {SUMMARY})")
    listed = summaries.groupBy("suite_id").agg(F.array_sort(F.collect_list(F.struct("segment", "summary"))).alias("s"))
    return listed.select("suite_id", F.aggregate("s", zero, lambda acc, x: compose(acc, x["summary"])).alias("summary"))


def apply_summaries(state: DataFrame, summaries: DataFrame) -> DataFrame:
    """(suite_id, current_version, latest_version, rejected) after the segments: ``state`` has these columns for the suites it
    knows; all others start at 0.  No operation is looked at again."""
    s = summaries.select(F.col("suite_id").alias("_suite"), "summary")
    j = state.join(s, F.col("suite_id").eqNullSafe(F.col("_suite")), "full")
    # Names of their own: a lambda would take the new latest version for the old one.
    j = j.select(F.coalesce("suite_id", "_suite").alias("suite_id"), "summary", *[
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"_{c}") for c in ("latest_version", "current_version", "rejected")])
    latest, current, rejected = (F.col(f"_{c}") for c in ("latest_version", "current_version", "rejected"))
    x = F.col("summary")
    reachable = F.filter(x["chain"], lambda c: c["need"] <= latest)
    first = F.get(reachable, F.lit(0))
    now = F.when(F.size(reachable) > 0, F.when(first["saved"], first["version"] + latest).otherwise(first["version"])).otherwise(current)
    refused = F.aggregate(F.filter(x["needs"], lambda n: n["need"] > latest), F.lit(0).cast("long"), lambda acc, n: acc + n["n"]) + x["refused"]
    return j.select("suite_id", F.when(x.isNotNull(), now).otherwise(current).alias("current_version"),
                    (latest + F.coalesce(x["saves"], F.lit(0))).alias("latest_version"), (rejected + F.coalesce(refused, F.lit(0))).alias("rejected"))


# ------------------------------------------------------------- change log

def apply_changes_to(state: DataFrame | None, ops: DataFrame, key: str = "id", seq: str = "seq", op: str = "op",
                     values: list[str] = ("name", "description")) -> DataFrame:
    """The registry (id, values, is_deleted, generation) after new operations, from the stored one: of the log only the new
    operations are replayed.  A stored record enters as what its history comes to: a creation with its values, and a
    deletion if it is deleted."""
    values = list(values)
    new = ops.select(F.col(key).alias("id"), F.struct(F.lit(1).alias("part"), F.col(seq).cast("long").alias("at")).alias("seq"), F.col(op).alias("op"), *values)
    if state is None:
        return registry_current(replay_changes(new, values=values), values)
    touched = new.select(F.col("id").alias("_id")).distinct()
    known = state.join(touched, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    untouched = state.join(touched, F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    place = lambda n: F.struct(F.lit(0).alias("part"), F.lit(n).cast("long").alias("at"))
    created = known.select("id", place(0).alias("seq"), F.lit("create").alias("op"), *values)
    deleted = known.filter("is_deleted").select("id", place(1).alias("seq"), F.lit("delete").alias("op"), *[F.lit(None).cast(state.schema[v].dataType).alias(v) for v in values])
    decided = replay_changes(created.unionByName(deleted).unionByName(new), values=values)
    after = registry_current(decided, values)
    before = known.select(F.col("id").alias("_id"), F.col("generation").alias("_before"))
    after = after.join(before, F.col("id").eqNullSafe(F.col("_id")), "left")
    # the stored creation counts as one; the generations before it are added back
    after = after.withColumn("generation", F.col("generation") + F.coalesce(F.col("_before") - 1, F.lit(0)))
    return untouched.select("id", *values, "is_deleted", "generation").unionByName(after.select("id", *values, "is_deleted", "generation"))
