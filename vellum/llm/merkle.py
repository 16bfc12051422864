"""Merkle manifest of a dataset, with proofs gained by butterfly exchange.

Rows are leaves, ordered by id within their source; every ``fanout`` consecutive
nodes become one, up to the source's subroot, and the subroots likewise up to the root.

1. One scan takes the digests of rows, and what else is to be proven.  Positions within
   a source come from prefix sums, so no source is sorted in one task.
2. ``fanout ** levels`` consecutive leaves form a block, a row of bounded size,
   whose own subtree is hashed in place.
3. Butterfly exchange: in round r the blocks whose numbers differ in digit r
   only (base ``fanout``) form an aligned group and swap the roots of the subtrees
   they know.  Each hashes the common parent for itself and keeps the others' roots as its
   proof.  After the last round every block has the root and its whole upper proof; nothing
   is passed down again.  A last subtree with fewer blocks than its neighbours
   is served to each of their groups by the block whose number fits, wrapped round.
   A round is one shuffle of a row a block, in groups of at most ``fanout``.
4. Subroots go through the same exchange with their source's number in place of the block's.
5. Blocks join their upper proof; leaves are folded in their block's task.

Defined cases: a null in a column counts as ``-``; null ids come first in a source, equal ids
stand in the order of their digests; equal rows are leaves of their own.  A null source
is a source, before all others.  A lone leaf is its subroot; proofs without siblings are the
hash of nothing.  An empty table gives an empty result.  Other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import saved
from vellum.plans.prefix import prefix_sums
from vellum.session import ship_code

FANOUT = 3
# Levels of a block's own subtree: 729 leaves at a fanout of 3.
LEVELS = 6

_PROVEN = "source string, doc_id {id}, leaf string, subroot string, root string, proof array<string>, folded_root string"


def encoded(values: list[Column]) -> Column:
    """Length-prefixed values in a row; ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_over(n: int, fanout: int = FANOUT) -> int:
    """Levels between ``n`` nodes and the one over all of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def butterfly(nodes: DataFrame, keys: list[str], most: int, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` (keys, ``at`` from 0, ``n`` of the keys, ``digest``) with the digest of the root
    over their keys' nodes in place of their own, and ``upper``: for each level on the way
    an array of [digests left, digests right].  ``most`` is the highest ``n``."""
    out = nodes.withColumn("upper", F.expr("cast(array() as array<array<array<string>>>)"))
    for r in range(levels_over(most, fanout)):
        width = fanout ** r
        # The nodes of one group know the subtrees under one parent, a node each; with fewer nodes in the
        # last subtree than there are groups, its nodes stand in the groups of their neighbours, too.
        digit = F.expr(f"cast((at div {width}) % {fanout} as int)")
        parent, own = F.expr(f"at div {width * fanout}"), F.expr(f"at % {width}")
        size = F.expr(f"least({width}L, n - (at div {width}) * {width})")
        out = out.select("*", digit.alias("digit"), parent.alias("parent"), own.alias("own"), size.alias("size"))
        served = F.when((F.col("digit") > 0) & (F.col("size") < width), F.sequence("own", F.lit(width - 1).cast("long"), "size")) \
            .otherwise(F.array("own"))
        sent = out.withColumn("group", F.explode(served))
        here = F.col("own") == F.col("group")  # elsewhere a node is a guest that brings its digest only
        sent = sent.select(*keys, "parent", "group", F.struct("digit", here.alias("here"), "digest", F.when(here, F.struct("at", "n", "upper")).alias("own")).alias("node"))
        met = sent.groupBy(*keys, "parent", "group").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        over = F.sha2(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""), 256)
        met = met.select(*keys, "nodes", over.alias("over"), F.explode("nodes").alias("node")).filter("node.here")
        side = lambda test: F.transform(F.filter("nodes", test), lambda x: x["digest"])
        siblings = F.array(side(lambda x: x["digit"] < F.col("node.digit")), side(lambda x: x["digit"] > F.col("node.digit")))
        done = F.col("node.own.n") <= width
        out = met.select(*keys, "node.own.at", "node.own.n", F.when(done, F.col("node.digest")).otherwise(F.col("over")).alias("digest"),
                         F.when(done, F.col("node.own.upper")).otherwise(F.concat("node.own.upper", F.array(siblings))).alias("upper"))
    return out


def _up(nodes: list[str], fanout: int) -> list[str]:
    return [digest(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]


def _subtree(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """A block's nodes level by level, from the leaves up."""
    rows = [leaves]
    for _ in range(levels):
        rows.append(_up(rows[-1], fanout))
    return rows


def _roots(levels: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, n = batch.column("leaves").to_pylist(), batch.column("n_leaves").to_pylist()
            roots = [_subtree([x["leaf"] for x in block], min(levels, levels_over(m, fanout)), fanout)[-1][0] for block, m in zip(leaves, n)]
            yield batch.append_column("digest", pa.array(roots, type=pa.string()))

    return run


def _folds(levels: int, fanout: int):
    """For each leaf of a block its proof, and the root that the leaf on trial folds up to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("leaves").type.value_type.field("doc_id").type
            for row in batch.to_pylist():
                leaves = row["leaves"]
                rows = _subtree([x["leaf"] for x in leaves], min(levels, levels_over(row["n_leaves"], fanout)), fanout)[:-1]
                above = [x for level in row["upper"] for x in level]
                made = []
                for at, leaf in enumerate(leaves):
                    ways, i = [], at
                    for nodes in rows:
                        first = i - i % fanout
                        ways.append((nodes[first:i], nodes[i + 1:first + fanout]))
                        i //= fanout
                    ways += row["upper"]
                    fold = reduce(lambda h, way: digest([*way[0], h, *way[1]]), ways, leaf["trial"])
                    made.append((leaf["doc_id"], leaf["leaf"], [h for way in ways[:len(rows)] for side in way for h in side], fold))
                sides = [h for side in above for h in side]
                n = len(made)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["source"]] * n, type=pa.string()), pa.array([m[0] for m in made], type=kind),
                    pa.array([m[1] for m in made], type=pa.string()), pa.array([row["subroot"]] * n, type=pa.string()),
                    pa.array([row["root"]] * n, type=pa.string()), pa.array([m[2] + sides for m in made], type=pa.list_(pa.string())),
                    pa.array([m[3] for m in made], type=pa.string())],
                    names=["source", "doc_id", "leaf", "subroot", "root", "proof", "folded_root"])

    return run


def manifest(docs: DataFrame, columns: list[str], trial: list[Column] | None = None, doc_id: str = "doc_id", source: str = "source",
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per input row: ``source``, ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (the
    siblings' digests, level by level, left to right) and ``folded_root``, what the proof and
    the leaf of the ``trial`` columns (by default the row's own) fold up to: another one than
    ``root`` if that row isn't what the manifest was made of.
    """
    spark = docs.sparkSession
    ship_code(spark)
    own = [F.col(f"`{c}`") for c in columns]
    leaf = F.sha2(encoded(own), 256)
    slim = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"), leaf.alias("leaf"),
                       (F.sha2(encoded(trial), 256) if trial else leaf).alias("trial"))
    # Null goes before all others; a source's key is never null, so that joins meet it.
    slim = saved(slim.withColumn("key", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))), "merkle-leaves")
    block = fanout ** levels
    placed = prefix_sums(slim, ["doc_id", "leaf", "trial"], [], group_cols=["key"])
    blocks = (placed.withColumn("at", F.expr("rows_cum - 1")).groupBy("key", F.expr(f"at div {block}").alias("at"))
              .agg(F.first("source").cast("string").alias("source"), F.first("rows_total").alias("n_leaves"),
                   F.sort_array(F.collect_list(F.struct(F.col("at").alias("place"), "doc_id", "leaf", "trial"))).alias("leaves")))
    with_root = T.StructType([*blocks.schema.fields, T.StructField("digest", T.StringType())])
    blocks = saved(blocks.mapInArrow(_roots(levels, fanout), with_root), "merkle-blocks")
    sources = saved(blocks.groupBy("key").agg(F.first("n_leaves").alias("n_leaves")), "merkle-sources")
    size = sources.agg(F.max("n_leaves").alias("leaves"), F.count(F.lit(1)).alias("sources")).first()
    nodes = blocks.select("key", "at", F.ceil(F.col("n_leaves") / block).alias("n"), "digest")
    known = saved(butterfly(nodes, ["key"], -(-(size["leaves"] or 0) // block), fanout), "merkle-known")
    tops = prefix_sums(known.filter("at = 0").select("key", "digest"), ["key"], [])
    tops = tops.select((F.col("rows_cum") - 1).alias("at"), F.col("rows_total").alias("n"), "digest", F.col("key").alias("top_key"))
    order = tops.select(F.col("at").alias("top_at"), "top_key")
    tops = butterfly(tops.select("at", "n", "digest"), [], size["sources"], fanout)
    tops = tops.join(order, F.col("at") == F.col("top_at")).select("top_key", F.col("digest").alias("root"), F.col("upper").alias("top_upper"))
    proofs = saved(known.join(tops, F.col("key") == F.col("top_key")).select(
        F.col("key").alias("of_key"), F.col("at").alias("of_at"), F.col("digest").alias("subroot"), "root",
        F.concat("upper", "top_upper").alias("upper")), "merkle-proofs")
    whole = blocks.join(proofs, (F.col("key") == F.col("of_key")) & (F.col("at") == F.col("of_at"))) \
        .select("source", "n_leaves", "leaves", "subroot", "root", "upper")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(_folds(levels, fanout), _PROVEN.format(id=kind))
