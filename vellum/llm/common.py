"""Helpers the training-data operators share.

* ``saved`` cuts lineage with a Parquet table under the shared checkpoint folder.
* ``mark_keys`` tests membership in a key set: through a bit table of a size set by the number of keys and bound
  to 64 MB, the only thing these operators ever broadcast by hint besides the hot groups below, or beyond that by a join.
* ``with_group`` joins rows to their group's row; groups that hold more than a
  thousandth of all rows (fewer than a thousand groups) are broadcast, all
  others are shuffled, so no group's rows meet in one task.
* ``repeated`` emits a row n times, large n over many tasks.
* ``with_made`` and ``where_text`` run a Python function over texts inside Spark's tasks,
  a run of about a million characters at a time; other columns pass as they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.session import fresh, freeing_shuffles, scratch_path, ship_code  # noqa: F401

# ASCII white space, and the words between it.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# One bucket of the bit table has as many bits as ``bitmap_construct_agg`` makes.
BUCKET_BITS = 32_768
# A bit table has about this many bits for each key, in a power of two of buckets of 4 KB: from 1024 buckets (4 MB)
# up to the bound of what is broadcast, 16384 (64 MB, 67 million keys).  With more keys rows are joined with the keys instead.
BITS_PER_KEY, BITMAP_BUCKETS, MOST_BUCKETS = 8, 1024, 16_384

HOT_PARTS = 1000
CHUNK = 4096
RUN_CHARS = 1 << 20


# Files per task slot of a table that is saved after a shuffle.
FILES_PER_SLOT = 4


def saved(df: DataFrame, name: str, shuffled: bool = False) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again.

    With ``shuffled``, for slim rows that come from a shuffle, the tasks that
    write are as many as keep every slot of the cluster busy: with more
    shuffle partitions than that, most files would hold a few rows.  The shuffle
    files go when the table is written: nobody reads them again.
    """
    if shuffled:
        df = df.coalesce(FILES_PER_SLOT * df.sparkSession.sparkContext.defaultParallelism)
    path = scratch_path(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _slot(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets * BUCKET_BITS))


def bitmap(df: DataFrame, *keys: Column, buckets: int = BITMAP_BUCKETS) -> DataFrame:
    """(bucket, bits): a bit for each key; at most ``buckets`` rows of 4 KB."""
    slot = _slot(list(keys), buckets)
    return (df.select(slot.alias("slot"))
            .groupBy(F.expr(f"slot div {BUCKET_BITS}").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("slot") % BUCKET_BITS).alias("bits")))


def bit_buckets(keys: int) -> int:
    """Buckets of a bit table for so many keys; 0: too many for one."""
    buckets = BITMAP_BUCKETS
    while buckets * BUCKET_BITS < keys * BITS_PER_KEY:
        buckets *= 2
    return buckets if buckets <= MOST_BUCKETS else 0


def mark_keys(df: DataFrame, keys: DataFrame, name: str, of_keys: list[Column], *of_rows: Column, n: int | None = None) -> DataFrame:
    """``df`` with the boolean ``name``: true for every row whose key ``keys`` (a written table) has, and
    possibly for a few others.  ``n`` is the number of keys, counted if it isn't given."""
    buckets = bit_buckets(keys.count() if n is None else n)
    if buckets:
        return marked(df, saved(bitmap(keys, *of_keys, buckets=buckets), "bits", shuffled=True), name, *of_rows, buckets=buckets)
    at, there = fresh(df, "at", "there")
    hashed = keys.select(F.xxhash64(*of_keys).alias(there)).distinct()
    joined = df.withColumn(at, F.xxhash64(*of_rows)).join(hashed, F.col(at) == F.col(there), "left")
    return joined.withColumn(name, F.col(there).isNotNull()).drop(at, there)


def marked(df: DataFrame, bits: DataFrame, name: str, *keys: Column, buckets: int = BITMAP_BUCKETS) -> DataFrame:
    """``df`` with the boolean ``name``: true for every row whose key is in
    ``bits``, and for the few others that share a bit with one.

    The table is broadcast: ``buckets`` * 4 KB is its proven bound.
    """
    at, bucket, data = fresh(df, "at", "bucket", "bits")
    side = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(data))
    slotted = df.withColumn(at, _slot(list(keys), buckets))
    joined = slotted.join(F.broadcast(side), F.expr(f"`{at}` div {BUCKET_BITS}") == F.col(bucket), "left")
    pos = (F.col(at) % BUCKET_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(data), F.expr(f"cast((`{at}` % {BUCKET_BITS}) div 8 as int) + 1"), F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("long"), pos % 8)
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(at, bucket, data)


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row per ``key``, ``size`` rows
    each) on the non-null ``key``.

    Groups of more than ``total / HOT_PARTS`` rows number fewer than
    ``HOT_PARTS``; they are broadcast, so a group with a third of all rows
    stays spread over the tasks that read it.
    """
    limit = total // HOT_PARTS
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    out = [key, *[c for c in rows.columns if c != key], *[c for c in groups.columns if c != key]]
    near = rows.join(hot, key).select(*out)
    far = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left").select(*out)
    return near.unionByName(far)


def repeated(df: DataFrame, times: str, index: str) -> DataFrame:
    """Each row ``times`` times (a long of 1 or more) with ``index`` from 0;
    rows with many repeats are dealt over the tasks in chunks."""
    chunk, = fresh(df, "chunk")
    last = F.col(times) - 1
    few = df.filter(F.col(times) <= CHUNK).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = (df.filter(F.col(times) > CHUNK)
            .withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {CHUNK}"))))
            .repartition(*[F.col(c) for c in (times, chunk)]))
    many = many.withColumn(index, F.explode(F.sequence(F.col(chunk) * CHUNK,
                                                       F.least(last, F.col(chunk) * CHUNK + CHUNK - 1)))).drop(chunk)
    return few.unionByName(many)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def runs(texts: pa.Array, most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def release_memory() -> None:
    """Gives back to the system what a task has freed; an idle Python worker would hold it during later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def with_made(docs: DataFrame, text: str, added: T.StructType, make: Callable[[list], list[list]], keep_text: bool = False,
              done: Callable[[], None] | None = None) -> DataFrame:
    """``docs`` (without ``text`` unless kept) and the ``added`` columns, whose
    values ``make`` gives, a list per column, for a list of texts; ``done`` is called at the end of each
    task, to drop what its worker would hold on to during later stages.  A column of ``docs`` with
    the name of an added one stays under that name with an underscore before it."""
    kept = [c for c in docs.columns if keep_text or c != text]
    ship_code(docs.sparkSession)
    whole, = fresh(docs, "whole_text")
    made_names = {f.name.lower() for f in added}
    taken = {c.lower() for c in kept} | made_names | {whole}
    names = {}
    for c in kept:
        names[c] = c
        if c.lower() in made_names:
            while names[c].lower() in taken:
                names[c] = f"_{names[c]}"
            taken.add(names[c].lower())
    source = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept], F.col(f"`{text}`").alias(whole))
    schema = T.StructType([*[f for f in source.schema if f.name != whole], *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            for start, n in runs(texts):
                made = make(texts.slice(start, n).to_pylist())
                columns = [batch.column(i).slice(start, n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(v, type=k) for v, k in zip(made, kinds)], names=schema.names)
        if done:
            done()
        release_memory()

    return source.mapInArrow(run, schema)


def where_text(docs: DataFrame, text: str, test: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text passes ``test``, which answers for a list
    of texts; all columns as they are."""
    ship_code(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in runs(batch.column(at)):
                part = batch.slice(start, n)
                yield part.filter(pa.array(test(part.column(at).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def columns(**kinds: T.DataType) -> T.StructType:
    """A schema of nullable columns."""
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
