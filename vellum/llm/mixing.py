"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are added up by membership pattern (the set of sources they belong
   to).  Only this small table reaches the driver: a row per pattern.
2. Targets: each source's share of the budget by weight, held to a number of
   repeats of its words, the excess shared out again (``fill_targets``).
3. A flow routes words from patterns to source quotas.  A pattern's k-th pass over
   its words costs k, so the flow repeats words only when fresh ones run out; of all
   flows that fill the quotas it takes the one with the least repetition.
4. Within a pattern every document gets the flow's whole passes; the rest goes to
   documents in the order of a seeded hash, up to the one where the words run out.
   Sums per hash range find the range that holds this point; only its rows
   are looked at one by one, and a few of them close the last gap.

The choice is a hash bound per pattern (and a few single hashes), so it is applied
in the scan, without a shuffle of documents, and reruns agree.

Defined cases: a null text has no words; a null source is a source of its own, last
in order; documents without sources or words are never taken; rows that agree in id
and text are taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, repeated, saved, word_count
from vellum.session import ship_code

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_PASSES = 2
SEED = 20_240_501
GAP_DOCS = 8


def source_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def fill_targets(sizes: dict, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = MAX_PASSES) -> dict:
    """Target of each source: its weight's share of ``budget`` times all words,
    at most ``cap`` times its own, the excess shared again among the rest."""
    order = source_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        left, open_ = max(left, 0.0), [s for s in open_ if s not in target]
    return target


def route(words: dict[tuple, int], quota: dict, passes: int = MAX_PASSES) -> dict[tuple, dict]:
    """Min-cost flow: {pattern: {source: words}}, a pattern giving at most
    ``passes`` times its words, its k-th pass at cost k a word.

    A source that no pattern shares with another one has one pattern and no choice: it gets its quota as far as
    its passes reach.  The others are the flow's affair: successive shortest paths over a graph with a node per pattern and source.
    """
    shared = {s for p in words if len(p) > 1 for s in p}
    alone = {p: {p[0]: min(passes * n, round(quota[p[0]]))} for p, n in words.items() if len(p) == 1 and p[0] not in shared}
    return alone | _flow({p: n for p, n in words.items() if p not in alone}, {s: quota[s] for s in quota if s in shared}, passes)


def _flow(words: dict[tuple, int], quota: dict, passes: int) -> dict[tuple, dict]:
    """``route`` for patterns that share sources."""
    patterns, sources = list(words), source_order(quota)
    n = len(patterns) + len(sources) + 2
    start, end = n - 2, n - 1
    at = {s: len(patterns) + i for i, s in enumerate(sources)}
    head, room, cost, edges = [], [], [], [[] for _ in range(n)]

    def arc(u: int, v: int, capacity: int, price: int) -> int:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            edges[a].append(len(head))
            head.append(b)
            room.append(c)
            cost.append(p)
        return len(head) - 2

    links = {}
    for i, p in enumerate(patterns):
        for k in range(passes):
            arc(start, i, words[p], k + 1)
        for s in p:
            links[p, s] = arc(i, at[s], passes * words[p], 0)
    for s in sources:
        arc(at[s], end, round(quota[s]), 0)
    while True:
        best, via, queue, queued = [float("inf")] * n, [-1] * n, deque([start]), [False] * n
        best[start] = 0
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in edges[u]:
                if room[e] > 0 and best[u] + cost[e] < best[head[e]]:
                    best[head[e]], via[head[e]] = best[u] + cost[e], e
                    if not queued[head[e]]:
                        queued[head[e]] = True
                        queue.append(head[e])
        if via[end] < 0:
            break
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = head[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {p: {s: room[links[p, s] ^ 1] for s in p} for p in patterns}


def _bound(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's rows at the edge: the last hash taken, and the hashes
    of the documents that close the gap."""
    rows = rows.sort_values("h", kind="stable")
    left = int(rows["left"].iloc[0])
    fits = rows["words"].cumsum() <= left
    taken = rows[fits]
    rest = rows[~fits & (rows["words"] > 0)]
    left -= int(taken["words"].sum())
    more = []
    for _ in range(GAP_DOCS):
        inside = rest[rest["words"] <= left]
        if inside.empty:
            break
        pick = inside["words"].idxmax()
        more.append(int(rest.at[pick, "h"]))
        left -= int(rest.at[pick, "words"])
        rest = rest.drop(index=pick)
    if not rest.empty:
        pick = (rest["words"] - left).abs().idxmin()
        if abs(int(rest.at[pick, "words"]) - left) < left:
            more.append(int(rest.at[pick, "h"]))
    last = int(taken["h"].iloc[-1]) if len(taken) else int(rows["h"].iloc[0]) - 1
    return pd.DataFrame({"pattern": [rows["pattern"].iloc[0]], "last": [last], "more": [more]})


def mix(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", *, weights: tuple = WEIGHTS,
        budget: float = BUDGET, passes: int = MAX_PASSES, seed: int = SEED) -> tuple[DataFrame, str, str, dict, dict]:
    """``docs`` with its word count and number of copies under two new columns.

    ``sources`` is an array column (null: no source).  Returns the frame, the two
    columns' names, each source's size and each source's target.
    """
    ship_code(docs.sparkSession)
    size, copies, pattern, h, plan_key = fresh(docs, "size", "copies", "pattern", "h", "plan_pattern")
    members = F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))
    members = F.concat(F.array_sort(F.filter(members, lambda s: s.isNotNull())), F.filter(members, lambda s: s.isNull()))
    # The top bit is cleared and one more left free: 62 bits, none negative.
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(F.col(text).cast("binary"))), 2)
    frame = docs.withColumns({size: word_count(F.col(text)), pattern: members, h: hashed})
    slim = saved(frame.select(F.to_json(pattern).alias("pattern"), F.col(pattern).alias("members"),
                              F.col(size).alias("words"), F.col(h).alias("h")), "mix-rows")
    # One row per pattern: as many as there are sets of sources that occur.
    by_pattern = slim.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("words").alias("words"),
                                             F.count(F.lit(1)).alias("n")).collect()
    words = {tuple(r["members"]): int(r["words"]) for r in by_pattern if r["members"]}
    sizes: dict = {}
    for p, n in words.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(words.values())
    target = fill_targets(sizes, weights, budget * total / max(1, sum(sizes.values())), passes)
    flow = route(words, target, passes)
    spark = docs.sparkSession
    plan = []
    # A pattern of n rows is cut into sqrt(n) / 4 ranges of 4 * sqrt(n) rows; single rows are read of one range.
    for r in by_pattern:
        p = tuple(r["members"])
        give = sum(flow.get(p, {}).values())
        whole = give // words[p] if words.get(p) else 0
        plan.append((r["pattern"], int(whole), int(give - whole * words.get(p, 0)), max(1, math.isqrt(r["n"]) // 4)))
    plan = spark.createDataFrame(plan, "pattern string, whole long, left long, ranges long")
    ranged = slim.join(F.broadcast(plan.filter("left > 0")), "pattern").withColumn(
        "at", F.floor(F.col("h").cast("double") / F.lit(float(1 << 62)) * F.col("ranges")).cast("long"))
    sums = ranged.groupBy("pattern", "left", "at").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("at")
    edge = (sums.withColumn("upto", F.sum("words").over(upto)).filter("upto >= left")
            .groupBy("pattern").agg(F.min_by(F.struct("at", (F.col("left") - F.col("upto") + F.col("words")).alias("left")), "at").alias("e"))
            .select("pattern", F.col("e.at").alias("at"), F.col("e.left").alias("left")))
    near = (ranged.drop("left").join(F.broadcast(edge), ["pattern", "at"])
            .groupBy("pattern", "left", "h").agg(F.sum("words").alias("words")))
    bound = near.groupBy("pattern").applyInPandas(_bound, "pattern string, last long, more array<long>")
    final = saved(plan.join(bound, "pattern", "left"), "mix-plan").select(
        F.col("pattern").alias(plan_key), F.struct("whole", "last", "more").alias(copies))
    joined = frame.join(F.broadcast(final), F.to_json(pattern) == F.col(plan_key), "left")
    extra = (F.col(h) <= F.col(copies)["last"]) | F.array_contains(F.col(copies)["more"], F.col(h))
    taken = F.coalesce(F.col(copies)["whole"], F.lit(0)) + F.coalesce(extra.cast("long"), F.lit(0))
    joined = joined.withColumn(copies, F.when(F.col(size) > 0, taken).otherwise(F.lit(0)).cast("long"))
    return joined.drop(pattern, h, plan_key), size, copies, sizes, target


def mixed(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken."""
    rows, _, copies, _, _ = mix(docs, sources, doc_id, text, **how)
    nth, = fresh(rows, "nth")
    return repeated(rows.filter(F.col(copies) > 0), copies, nth).select(*docs.columns)
