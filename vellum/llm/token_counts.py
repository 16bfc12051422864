"""Token counts from an exact length histogram.

Documents are encoded in their tasks and leave one number each; the numbers are
counted per length with map-side combine.  All that is asked later (totals, quantiles,
totals under a context limit) comes from suffix sums over the histogram, which has a
row per distinct length, whatever the number of documents.

Defined cases: a null text has 0 tokens; a null key is a key of its own; an empty
table has an empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import bpe


def token_lengths(docs: DataFrame, tokens: bytes, pattern: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text``, with the number of ids of its whole text."""
    return bpe.encode(docs, tokens, pattern, text, n_tokens=n_tokens)


def histogram(lengths: DataFrame, keys: list[str], n_tokens: str = "n_tokens") -> DataFrame:
    """``keys``, ``n_tokens``, ``n_docs`` and, within the keys: ``docs_at_least``
    and ``tokens_at_least`` (suffix sums, this length included), ``docs_all``,
    ``tokens_all``, ``share_at_most`` (the quantile this length is the value of) and
    ``tokens_truncated`` (the total if each document were cut to this length)."""
    counts = lengths.groupBy(*keys, n_tokens).agg(F.count(F.lit(1)).alias("n_docs"))
    return suffix_sums(counts, keys, n_tokens)


def suffix_sums(counts: DataFrame, keys: list[str], n_tokens: str = "n_tokens") -> DataFrame:
    """The sums of ``histogram`` over a table of (keys, length, n_docs)."""
    down = Window.partitionBy(*keys).orderBy(F.col(n_tokens).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    mass = F.col(n_tokens) * F.col("n_docs")
    sums = counts.select(*keys, n_tokens, "n_docs", F.sum("n_docs").over(down).alias("docs_at_least"),
                         F.sum(mass).over(down).alias("tokens_at_least"),
                         F.sum("n_docs").over(whole).alias("docs_all"), F.sum(mass).over(whole).alias("tokens_all"))
    return sums.select("*", ((F.col("docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_all")).alias("share_at_most"),
                       (F.col("tokens_all") - F.col("tokens_at_least") + F.col(n_tokens) * F.col("docs_at_least")).alias("tokens_truncated"))


def totals_at(hist: DataFrame, keys: list[str], limits: list[int], n_tokens: str = "n_tokens") -> DataFrame:
    """(keys, context_limit, docs_cut, tokens_kept) for any limits."""
    per = [F.struct(F.lit(int(limit)).cast("long").alias("context_limit"),
                    F.coalesce(F.sum(F.when(F.col(n_tokens) > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
                    F.coalesce(F.sum(F.least(F.col(n_tokens), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"))
           for limit in limits]
    return hist.groupBy(*keys).agg(F.array(*per).alias("per")).select(*keys, F.inline("per"))


def quantiles(hist: DataFrame, keys: list[str], shares: list[float], n_tokens: str = "n_tokens") -> DataFrame:
    """(keys, share, n_tokens): the least length that this share of the documents
    doesn't exceed."""
    per = [F.struct(F.lit(float(q)).alias("share"),
                    F.min(F.when(F.col("share_at_most") >= q, F.col(n_tokens))).alias(n_tokens)) for q in shares]
    return hist.groupBy(*keys).agg(F.array(*per).alias("per")).select(*keys, F.inline("per"))
