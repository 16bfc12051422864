"""Metric library: classification, regression, ranking, text overlap, vectors.

Every metric is a DataFrame -> DataFrame aggregate (optionally per run via
``group``), built from JVM-side expressions.  Only the n-gram counts of the
text metrics run in Python, on Arrow batches: a pair of texts is one row, so its
n-grams never need a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.plans.prefix import prefix_sums
from vellum.session import ship_code

# Names of the averaged rows of a classification report.
AVERAGE_ROWS = ["macro avg", "micro avg", "weighted avg"]
# Token separator of the text metrics: ASCII whitespace runs.
TOKEN_SPLIT = "[ \t\n\r\f]+"


def _g(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group or [])


def _safe_div(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- vectors

def cosine_similarity(a, b) -> Column:
    """M1: cosine of two equal-length vectors in double; a zero vector gives 0."""
    a = F.col(a).cast("array<double>") if isinstance(a, str) else a
    b = F.col(b).cast("array<double>") if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
    nb = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x * x)
    den = F.sqrt(na) * F.sqrt(nb)
    return F.when(den > 0, dot / den).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- classification

def accuracy(df: DataFrame, t: str = "y_true", p: str = "y_pred", group=None) -> DataFrame:
    """M2: share of rows with y_true = y_pred.  Null is a label like any other, as in M3-M6."""
    return df.groupBy(*_g(group)).agg(
        F.avg(F.col(t).eqNullSafe(F.col(p)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, t: str = "y_true", p: str = "y_pred", group=None) -> DataFrame:
    """Counts per (true, predicted) pair -- a partial aggregate, K^2 rows out."""
    return df.groupBy(*_g(group), F.col(t).alias("y_true"), F.col(p).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _labelled_grid(df: DataFrame, group: list[str], labels: list, *names: str) -> DataFrame:
    """Every group with every combination of the given labels: the list is a
    parameter, so nothing about the data reaches the driver."""
    out = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    for name in names:
        out = out.select("*", F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))
    return out


def confusion_matrix(df: DataFrame, t: str = "y_true", p: str = "y_pred", group=None, labels: list | None = None) -> DataFrame:
    """M6: counts by (true, predicted), per run with ``group``: the pairs that
    occur, or with ``labels`` every pair of these, absent ones as 0.  Null is a
    label like any other."""
    keys = _g(group)
    counts = pair_counts(df, t, p, group)
    if labels is None:
        return counts
    zero = _labelled_grid(df, keys, labels, "y_true", "y_pred").withColumn("n", F.lit(0).cast("bigint"))
    wanted = reduce(Column.__and__, [reduce(Column.__or__, [F.col(c).eqNullSafe(F.lit(x)) for x in labels])
                                     for c in ("y_true", "y_pred")])
    return (counts.filter(wanted).unionByName(zero.select(*counts.columns))
            .groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n")))


def classification_report(df: DataFrame, t: str = "y_true", p: str = "y_pred", group=None, labels: list | None = None,
                          average: str | None = None) -> DataFrame:
    """M3-M5: per label precision, recall, F1 and support, plus macro, micro and
    weighted averages, per run with ``group``; 0/0 counts as 0.

    Null is a label like any other.  ``labels`` restricts the report and its
    averages to these labels (absent ones count with zeros); ``average`` keeps
    one averaged row: macro, micro or weighted.
    """
    keys = _g(group)
    pc = pair_counts(df, t, p, group)
    hit = F.col("y_true").eqNullSafe(F.col("y_pred"))
    zero = F.lit(0).cast("bigint")
    sides = pc.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
                 zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("predicted")))).alias("s"))
    sides = sides.select(*keys, "s.*")
    if labels is not None:
        wanted = reduce(Column.__or__, [F.col("label").eqNullSafe(F.lit(x)) for x in labels])
        none = _labelled_grid(df, keys, labels, "label")
        sides = sides.filter(wanted).unionByName(none.withColumns({c: zero for c in ("support", "tp", "predicted")}))
    per = sides.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = per.select(*keys, "label", "support", "tp", "predicted", prec.alias("precision"), rec.alias("recall"))
    per = per.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
    tot = per.groupBy(*keys).agg(
        F.sum("support").alias("s"), F.sum("tp").alias("tp"), F.sum("predicted").alias("pr"), F.count(F.lit(1)).alias("k"),
        F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    micro_p, micro_r = _safe_div(F.col("tp"), F.col("pr")), _safe_div(F.col("tp"), F.col("s"))
    rows = {
        "macro avg": [F.col(c) / F.col("k") for c in ("sp", "sr", "sf")],
        "micro avg": [micro_p, micro_r, _safe_div(2 * micro_p * micro_r, micro_p + micro_r)],
        "weighted avg": [_safe_div(F.col(c), F.col("s")) for c in ("wp", "wr", "wf")],
    }
    if average is not None:
        rows = {f"{average} avg": rows[f"{average} avg"]}
    avgs = tot.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("label"), *[v.alias(c) for v, c in zip(values, ("precision", "recall", "f1"))],
                 F.col("s").alias("support")) for name, values in rows.items()])).alias("r")).select(*keys, "r.*")
    if average is not None:
        return avgs
    return per.select(*keys, F.col("label").cast("string"), "precision", "recall", "f1", "support").unionByName(avgs)


def auc_roc(df: DataFrame, y: str = "y_true", score: str = "score", group=None) -> DataFrame:
    """M7: ROC AUC = Mann-Whitney U / (P * N), ties count one half, per run
    with ``group``.  Rows without a label or score are skipped.

    A histogram by distinct score (partial aggregate) followed by a two-phase
    prefix sum of negatives in score order -- no single-task global window.
    """
    keys = _g(group)
    known = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    hist = known.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    cum = prefix_sums(hist, ["score"], ["neg"], group_cols=keys)
    below = (F.col("neg_cum") - F.col("neg")).cast("double")
    return (cum.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.lit(0.5) * F.col("neg"))).alias("u"),
                                   F.sum("pos").alias("p"), F.sum("neg").alias("n"))
            .select(*keys, _safe_div(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"),
                    F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("n", F.lit(0)).alias("negatives")))


# ---------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, t: str = "y_true", p: str = "y_pred", group=None) -> DataFrame:
    """M8-M12 in one pass: MAE, MSE, RMSE, R^2 (1 - SSres/SStot) and MAPE
    (percent; rows with y = 0 skipped).  All of them, and ``n``, are taken over
    the rows that have both values; a group without such rows has n = 0 and nulls."""
    d = F.col(t) - F.col(p)
    known = F.when(d.isNotNull(), F.col(t))
    agg = df.groupBy(*_g(group)).agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sum(d * d).alias("_ssr"),
        F.var_pop(known).alias("_var"), F.count(d).alias("n"),
        (F.lit(100.0) * F.avg(F.abs(d / F.when(known != 0, known)))).alias("mape"))
    sst = F.col("_var") * F.col("n")
    return agg.select(*_g(group), "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      F.when(sst > 0, F.lit(1.0) - F.col("_ssr") / sst).alias("r2"), "mape")


# ---------------------------------------------------------------- text overlap

def _overlaps(ref: str | None, out: str | None, orders) -> list[tuple[int, int, int]]:
    """(clipped overlap, n-grams of the output, of the reference) per order."""
    r, o = [[w for w in re.split(TOKEN_SPLIT, x or "") if w] for x in (ref, out)]
    made = []
    for n in orders:
        have, said = [Counter(zip(*[w[i:] for i in range(n)])) for w in (r, o)]
        made.append((sum(min(c, have[g]) for g, c in said.items()), said.total(), have.total()))
    return made + [(0, len(o), len(r))]


def ngram_overlap(df: DataFrame, keep: list[str], ref: str, out: str, orders=(1, 2, 3, 4)) -> DataFrame:
    """Per (pair, n): clipped overlap, output n-gram count, reference n-gram
    count, and the token numbers of both texts.

    A pair is whole in its row, so it is counted where it is read; nothing is
    shuffled.
    """
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "overlap", "out_total", "ref_total", "out_len", "ref_len")])
    base = df.select(*keep, F.col(ref).alias("_r"), F.col(out).alias("_o"))
    schema = T.StructType([*base.schema.fields[:-2], T.StructField("per", T.ArrayType(counts))])
    orders = list(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in counts.names]))
        for batch in batches:
            rows = []
            for r, o in zip(batch.column("_r").to_pylist(), batch.column("_o").to_pylist()):
                *per, (_, out_len, ref_len) = _overlaps(r, o, orders)
                rows.append([dict(zip(counts.names, (n, *x, out_len, ref_len))) for n, x in zip(orders, per)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, type=kind)], names=schema.names)

    ship_code(df.sparkSession)
    return base.mapInArrow(run, schema).select(*keep, F.inline("per"))


def bleu(df: DataFrame, key: list[str] = (), ref: str = "reference", out: str = "output", group=None) -> DataFrame:
    """Corpus BLEU-4 (single reference), per run with ``group``: clipped
    n-gram precisions n = 1..4, geometric mean, brevity penalty; any zero
    precision gives 0.  A pair is a row, so ``key`` isn't needed to tell pairs apart."""
    keys = _g(group)
    ov = ngram_overlap(df, keys, ref, out)
    ks = (1, 2, 3, 4)
    summary = ov.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("n") == k, F.col("overlap"))).alias(f"m{k}") for k in ks],
        *[F.sum(F.when(F.col("n") == k, F.col("out_total"))).alias(f"t{k}") for k in ks],
        F.sum(F.when(F.col("n") == 1, F.col("out_len"))).cast("bigint").alias("hyp_len"),
        F.sum(F.when(F.col("n") == 1, F.col("ref_len"))).cast("bigint").alias("ref_len"))
    summary = summary.select(*keys, *[_safe_div(F.col(f"m{k}"), F.col(f"t{k}")).alias(f"p{k}") for k in ks],
                             "hyp_len", "ref_len")
    pr = [F.col(f"p{k}") for k in ks]
    allpos = reduce(lambda a, b: a & b, [c > 0 for c in pr])
    # ln(0) is guarded: the geometric mean is only taken when every p_n > 0
    geo = F.exp(reduce(lambda a, b: a + b, [F.log(F.when(c > 0, c)) for c in pr]) / 4)
    c, r = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(c == 0, F.lit(0.0)).when(c < r, F.exp(F.lit(1.0) - r / c)).otherwise(F.lit(1.0))
    return summary.select(*keys, F.when(allpos, bp * geo).otherwise(F.lit(0.0)).alias("bleu"),
                          bp.alias("brevity_penalty"), *pr, "hyp_len", "ref_len")


def rouge_n(df: DataFrame, key: list[str] = (), ref: str = "reference", out: str = "output",
            orders=(1, 2), group=None) -> DataFrame:
    """ROUGE-N recall / precision / F1 per pair, averaged over pairs, per
    run with ``group``."""
    keys = _g(group)
    ov = ngram_overlap(df, keys, ref, out, orders)
    r = _safe_div(F.col("overlap"), F.col("ref_total"))
    p = _safe_div(F.col("overlap"), F.col("out_total"))
    per = ov.select(*keys, F.col("n").cast("int").alias("n"), r.alias("r"), p.alias("p"))
    per = per.withColumn("f", _safe_div(2 * F.col("r") * F.col("p"), F.col("r") + F.col("p")))
    return per.groupBy(*keys, "n").agg(F.avg("r").alias("recall"), F.avg("p").alias("precision"),
                                       F.avg("f").alias("f1"), F.count(F.lit(1)).alias("pairs"))


# ---------------------------------------------------------------- ranking

def _salted_top_k(df: DataFrame, q: list[str], order: list[Column], k: int, salts: int) -> DataFrame:
    """Top k rows per query in ``order``; a first cut per (query, salt) keeps a
    hot query from landing in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    w1 = Window.partitionBy(*q, "_salt").orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*q).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def ndcg_per_query(df: DataFrame, k: int = 10, q: str = "query_id", item: str = "item_id",
                   score: str = "score", grade: str = "grade", salts: int = 16, group=None) -> DataFrame:
    """NDCG@k per query (of each run with ``group``): gain 2^g - 1, discount
    log2(rank + 1), ranking by score desc then item id; ideal = grades desc;
    ideal 0 -> 0."""
    keys = [*_g(group), q]
    base = df.select(*keys, item, score, grade)
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    disc = F.log2(F.col("rank") + 1)
    top = lambda order: _salted_top_k(base, keys, order, k, salts).select(*keys, (gain / disc).alias("_v"))
    # Both sums in one aggregate: a join on the keys would lose a null run or query.
    ranked = top([F.col(score).desc(), F.col(item).asc()]).withColumn("_ideal", F.lit(False))
    ideal = top([F.col(grade).desc(), F.col(item).asc()]).withColumn("_ideal", F.lit(True))
    sums = ranked.unionByName(ideal).groupBy(*keys).agg(F.sum(F.when(~F.col("_ideal"), F.col("_v"))).alias("dcg"),
                                                        F.sum(F.when(F.col("_ideal"), F.col("_v"))).alias("idcg"))
    return sums.select(*keys, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def average_precision_per_query(df: DataFrame, q: str = "query_id", item: str = "item_id", score: str = "score",
                                grade: str = "grade", relevant_grade: int = 2, group=None) -> DataFrame:
    """AP per query (of each run with ``group``) = mean over relevant items
    of precision at their rank; a query without relevant items scores 0.  Ranks
    come from the two-phase prefix sum (no per-query single-task window)."""
    keys = [*_g(group), q]
    base = df.select(*keys, F.col(item).alias("_item"), (-F.col(score)).alias("_neg_score"),
                     (F.col(grade) >= relevant_grade).cast("int").alias("rel"))
    cum = prefix_sums(base, ["_neg_score", "_item"], ["rel"], group_cols=keys)
    prec = F.col("rel_cum") / F.col("rows_cum")
    return (cum.groupBy(*keys).agg(F.sum(F.when(F.col("rel") == 1, prec)).alias("_s"), F.sum("rel").alias("_r"))
            .select(*keys, F.when(F.col("_r") > 0, F.col("_s") / F.col("_r")).otherwise(F.lit(0.0)).alias("ap")))


def reciprocal_rank_per_query(df: DataFrame, q: str = "query_id", item: str = "item_id", score: str = "score",
                              grade: str = "grade", relevant_grade: int = 2, group=None) -> DataFrame:
    """1 / rank of the first relevant item (none -> 0), per query (of each
    run with ``group``); items may have ids of any ordered type.

    The best relevant item per query is a min aggregate; its rank is one plus
    the number of items ranked above it, another aggregate -- both partial
    (map-side), so a hot query is no single task.
    """
    keys = [*_g(group), q]
    rank_key = F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))
    names = [f"_best_{i}" for i in range(len(keys))]
    best = (df.filter(F.col(grade) >= relevant_grade).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
            .agg(F.min(rank_key).alias("_best")))
    # a null run or query is one like any other
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    ranked = df.select(*keys, rank_key.alias("_k")).join(best, same, "left").groupBy(*keys).agg(
        F.count_if(F.col("_k") < F.col("_best")).alias("_above"), F.count("_best").alias("_found"))
    return ranked.select(*keys, F.when(F.col("_found") > 0, F.lit(1.0) / (F.col("_above") + 1)).otherwise(F.lit(0.0)).alias("rr"))


def mean_of(df: DataFrame, col: str, name: str, group=None) -> DataFrame:
    return df.groupBy(*_g(group)).agg(F.avg(col).alias(name), F.count(F.lit(1)).alias("n_queries"))


# ---------------------------------------------------------------- long form

def metrics_long(wide: DataFrame, keys: list[str], metric_cols: list[str]) -> DataFrame:
    """Wide metric columns -> (keys..., metric_name, metric_value)."""
    return wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metric_cols]) \
        .unpivot(keys, metric_cols, "metric_name", "metric_value")


def threshold_check(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metric >= threshold -> pass (metrics without a threshold are not
    reported).  The threshold table is one row per metric name."""
    return (long.join(thresholds, "metric_name", "inner")
            .withColumn("passed", F.col("metric_value") >= F.col("threshold")))


# ---------------------------------------------------------------- dispatch by name

def _ranked(per_query, metric: str):
    def run(df, group, c, options, names):
        how = {k: options[k] for k in ("k", "relevant_grade") if k in options and (k == "k") == (metric == "ndcg")}
        per = per_query(df, q=c["query_id"], item=c["item_id"], score=c["score"], grade=c["grade"], group=group, **how)
        return mean_of(per, metric, names[0], group)
    return run


def _averaged(df, group, c, options, names):
    report = classification_report(df, c["y_true"], c["y_pred"], group, options.get("labels"), options.get("average", "macro"))
    return report.withColumn("f1_score", F.col("f1"))


def _rouge(df, group, c, options, names):
    orders = [int(x[-1]) for x in names]
    scores = rouge_n(df, ref=c["reference"], out=c["output"], orders=orders, group=group)
    return scores.groupBy(*group).agg(*[F.max(F.when(F.col("n") == n, F.col("f1"))).alias(x) for n, x in zip(orders, names)])


# Metrics that come from one pass: family -> (its names, (rows, group, columns, options, wanted names) -> a column a name).
FAMILIES = {
    "accuracy": (("accuracy",), lambda df, group, c, options, names: accuracy(df, c["y_true"], c["y_pred"], group)),
    "averages": (("precision", "recall", "f1_score"), _averaged),
    "auc": (("auc_roc",), lambda df, group, c, options, names: auc_roc(df, c["y_true"], c["score"], group).withColumnRenamed("auc", "auc_roc")),
    "regression": (("mae", "mse", "rmse", "r2", "mape"), lambda df, group, c, options, names: regression_metrics(df, c["y_true"], c["y_pred"], group)),
    "bleu": (("bleu",), lambda df, group, c, options, names: bleu(df, ref=c["reference"], out=c["output"], group=group)),
    "rouge": (("rouge_1", "rouge_2"), _rouge),
    "ndcg": (("ndcg",), _ranked(ndcg_per_query, "ndcg")),
    "map": (("map",), _ranked(average_precision_per_query, "ap")),
    "mrr": (("mrr",), _ranked(reciprocal_rank_per_query, "rr")),
}
RUN_METRICS = {name: family for family, (names, _) in FAMILIES.items() for name in names}

COLUMNS = {c: c for c in ("y_true", "y_pred", "score", "reference", "output", "query_id", "item_id", "grade")}


def run_metrics(df: DataFrame, names: list[str], group, columns: dict[str, str] | None = None,
                options: dict[str, dict] | None = None) -> DataFrame:
    """E6 over whole runs: the named metrics per group as the long table
    (group..., metric_name, metric_value).  Unknown names are ignored; names that one
    pass gives (the regression errors, the classification averages) take one pass together.

    ``columns`` renames the columns metrics read; ``options`` gives a metric's
    parameters (labels, average, k, relevant_grade).  ``confusion_matrix`` gives a row per
    pair, named ``confusion_matrix[true,predicted]``.
    """
    keys, c, options = _g(group), COLUMNS | (columns or {}), options or {}
    parts, wanted = [], {}
    for name in dict.fromkeys(names):
        given = options.get(name, {})
        if name == "confusion_matrix":
            m = confusion_matrix(df, c["y_true"], c["y_pred"], keys, given.get("labels"))
            label = F.concat(F.lit("confusion_matrix["), F.coalesce(F.col("y_true").cast("string"), F.lit("null")), F.lit(","),
                             F.coalesce(F.col("y_pred").cast("string"), F.lit("null")), F.lit("]"))
            parts.append(m.select(*keys, label.alias("metric_name"), F.col("n").cast("double").alias("metric_value")))
        elif name in RUN_METRICS:
            # one pass for all names of a family that have the same parameters
            wanted.setdefault((RUN_METRICS[name], repr(sorted(given.items()))), (given, []))[1].append(name)
    for (family, _), (given, mine) in wanted.items():
        parts.append(metrics_long(FAMILIES[family][1](df, keys, c, given, mine), keys, mine))
    if not parts:
        return df.select(*keys, F.lit("").alias("metric_name"), F.lit(0.0).alias("metric_value")).limit(0)
    return reduce(DataFrame.unionByName, parts)
