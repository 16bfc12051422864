"""Keyword search by an index of trigrams (P6, P8, P15 over large tables).

The index holds, for every trigram of the lower-cased text of an indexed column, the ids
of the rows that have it: a posting a row, dealt by (trigram, part).  Parts follow the number of
postings, so a trigram that nearly every row has is many files' affair.  A search reads the postings of the keyword's rarest
trigrams only, keeps ids that have them all, and verifies these rows by the same ILIKE as the scan.

Keywords that the index can't answer go to the scan: those with a live wildcard or an
escape, and those shorter than three characters.  So do keywords with a character whose case isn't
folded one to one; rows come back as the scan gives them, in any case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import scalar as S
from vellum.session import saved

GRAM = 3
# A search intersects the postings of so many of a keyword's trigrams, the rarest ones.
RAREST = 4
# Postings in one file of the index, about.
FILE_POSTINGS = 2_000_000


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text's lower case; shorter texts and null have none."""
    # one pass: at every place the three characters that follow
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def indexable(keyword: str) -> bool:
    """Whether the index answers this keyword; all others go to the scan."""
    plain = not set(keyword) & set("%_\\")
    return plain and len(keyword) >= GRAM and all(len(c.lower()) == len(c.upper()) == 1 and c.lower().upper() == c.upper() for c in keyword)


@dataclass
class TrigramIndex:
    """Postings (column_name, gram, id) of a table, and (column_name, gram, n): how many each has."""

    postings: DataFrame
    counts: DataFrame
    columns: list[str]


def build(df: DataFrame, id_col: str, columns: list[str], path: str, file_postings: int = FILE_POSTINGS) -> TrigramIndex:
    """Writes the index of ``columns`` below ``path``."""
    ided = df.select(F.col(id_col).alias("id"), *columns)
    each = ided.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), grams_of(F.col(c)).alias("grams")) for c in columns])).alias("g"))
    # A text is cut into trigrams once; counts, the range boundaries and the postings read what that gave.
    each = saved(each.select("g.column_name", "g.grams", "id"), "trigram-rows")
    postings = each.select("column_name", F.explode("grams").alias("gram"), "id")
    counts = postings.groupBy("column_name", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    spark = df.sparkSession
    counts = spark.read.parquet(f"{path}/counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // file_postings))
    # The range goes on within a trigram, so a hot one is cut into parts; sorted, row groups tell trigrams apart.
    (postings.repartitionByRange(files, "column_name", "gram", "id").sortWithinPartitions("column_name", "gram", "id")
     .write.mode("overwrite").parquet(f"{path}/postings"))
    return load(spark, path, columns)


def load(spark: SparkSession, path: str, columns: list[str]) -> TrigramIndex:
    return TrigramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"), list(columns))


def _keyword_grams(keyword: str) -> list[str]:
    low = keyword.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def candidates(index: TrigramIndex, keyword: str, columns: list[str] | None = None) -> DataFrame:
    """Ids of the rows that have the keyword's rarest trigrams in one of the columns.  The trigrams of the
    keyword, and a count for each, are all that reaches the driver."""
    wanted, columns = _keyword_grams(keyword), columns or index.columns
    of = F.col("column_name").isin(columns) & F.col("gram").isin(wanted)
    n = {(r["column_name"], r["gram"]): r["n"] for r in index.counts.filter(of).collect()}
    picked = {c: sorted(wanted, key=lambda g: (n.get((c, g), 0), g))[:RAREST] for c in columns}
    # a trigram that no row has leaves its column without candidates
    picked = {c: g for c, g in picked.items() if all((c, x) in n for x in g)}
    if not picked:
        return index.postings.select("id").limit(0)
    mine = reduce(Column.__or__, [(F.col("column_name") == c) & F.col("gram").isin(g) for c, g in picked.items()])
    needed = F.create_map(*[x for c, g in picked.items() for x in (F.lit(c), F.lit(len(g)))])
    both = index.postings.filter(mine).groupBy("column_name", "id").agg(F.count(F.lit(1)).alias("n"))
    return both.filter(F.col("n") >= needed[F.col("column_name")]).select("id").distinct()


def search(df: DataFrame, index: TrigramIndex, keyword: str, id_col: str = "id", columns: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` that hold the keyword in one of the columns: what the scan gives."""
    columns = columns or index.columns
    hit = reduce(Column.__or__, [F.coalesce(S.ilike(c, f"%{keyword}%"), F.lit(False)) for c in columns])
    if not indexable(keyword):
        return df.filter(hit)
    found = candidates(index, keyword, columns).withColumnRenamed("id", "_found")
    return df.join(found, F.col(id_col) == F.col("_found"), "left_semi").filter(hit)


def search_many(df: DataFrame, index: TrigramIndex, keywords: DataFrame, keyword: str = "keyword", id_col: str = "id",
                columns: list[str] | None = None) -> DataFrame:
    """(keyword, id) for every row that holds one of many keywords (plain text, three characters or more; others are
    left out): the keywords' trigrams meet the postings, ids with all of a keyword's trigrams are verified."""
    columns = columns or index.columns
    asked = keywords.select(F.col(keyword).alias("keyword")).filter("keyword is not null").distinct()
    plain = (F.length("keyword") >= GRAM) & ~F.col("keyword").rlike(r"[%_\\]")
    asked = saved(asked.filter(plain).withColumn("grams", grams_of(F.col("keyword"))), "trigram-keywords")
    each = asked.select("keyword", F.size("grams").alias("needed"), F.explode("grams").alias("gram"))
    counts = index.counts.filter(F.col("column_name").isin(columns))
    # the rarest of a keyword's trigrams; one that no row has is the rarest of all
    counted = each.join(counts, "gram", "left").groupBy("keyword", "gram", "needed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rare = counted.groupBy("keyword").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram"))), 1, RAREST).alias("g"))
    rare = rare.select("keyword", F.size("g").alias("needed"), F.explode("g.gram").alias("gram"))
    met = index.postings.filter(F.col("column_name").isin(columns)).join(rare, "gram").groupBy("keyword", "column_name", "id") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).filter("n >= needed").select("keyword", "id").distinct()
    text = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    rows = df.select(F.col(id_col).alias("id"), text.alias("texts"))
    low = F.lower("keyword")
    return met.join(rows, "id").filter(F.exists("texts", lambda t: F.contains(t, low))).select("keyword", "id").distinct()
