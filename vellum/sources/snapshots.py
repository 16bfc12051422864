"""Run tables as snapshots: a manifest names the files, a swap of manifests is a commit
(compaction of S8 / S12, point lookups of P2-P5 / S6).

Layout below one root on shared storage::

    {root}/data/{commit}/part-*.parquet     written once, never changed
    {root}/manifests/v={n}/part-*.parquet   one file: a row for each data file of snapshot n
    {root}/blooms/{commit}/part-*.parquet   Bloom filters of the commit's files

A snapshot is there once its manifest's single file is: that file comes into place by one rename, so a
reader sees the snapshot before or the one after, never a mixture, and a writer that dies between data and
manifest leaves nothing that anyone reads.  Readers keep to the snapshot they started with; ``vacuum``
removes what no kept snapshot names.

A manifest row has the file's path, rows, bytes and the least and greatest value of each index column.
With them and the Bloom filters a lookup of few keys opens only files that may hold one.
Compaction rewrites small files, clustered by a key that interleaves the bits of the index columns'
quantile numbers, so ranges of every one of them are narrow in each new file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import saved

# A Bloom filter has about so many bits a row and so many hash functions: one key in 130 passes by chance.
BLOOM_BITS, BLOOM_HASHES = 10, 4
# bits of one row of a filter's table, kept as words of 64
BLOCK_BITS, WORD_BITS = 32_768, 64
# More keys than this are joined with the whole table instead of being probed.
LOOKUP_KEYS = 10_000
# Quantile numbers that a clustering key interleaves: 2 ** this many a column.
CLUSTER_BITS = 8


class SnapshotConflict(RuntimeError):
    """Another writer committed this version first."""


class SnapshotTable:
    """A table of immutable Parquet files below ``root``; ``index`` names the columns that lookups and
    compaction go by."""

    def __init__(self, spark: SparkSession, root: str, index: list[str]):
        self.spark, self.root, self.index = spark, root.rstrip("/"), list(index)

    # ------------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        """Committed versions, in order."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/manifests")
            # a manifest that is being written has no file yet
            found = files.select(F.regexp_extract("path", r"/v=([0-9]+)/part-[^/]+\.parquet$", 1).alias("v")).filter("v != ''").distinct()
            return sorted(int(r["v"]) for r in found.collect())
        except Exception as e:  # noqa: BLE001 -- no snapshot yet
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return []
            raise

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """The files of a snapshot (the latest by default)."""
        if version is None:
            version = max(self.versions(), default=None)
        return None if version is None else self.spark.read.parquet(f"{self.root}/manifests/v={version}")

    def _commit(self, rows: DataFrame, version: int) -> int:
        """Writes the manifest of ``version``: the swap."""
        try:
            rows.coalesce(1).write.mode("error").parquet(f"{self.root}/manifests/v={version}")
        except Exception as e:  # noqa: BLE001 -- told apart below
            if "PATH_ALREADY_EXISTS" in str(e) or "already exists" in str(e):
                raise SnapshotConflict(f"version {version} is there already") from e
            raise
        return version

    # ------------------------------------------------------------- writing

    def _staged(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and its Bloom filters; the new files' manifest rows."""
        commit = uuid.uuid4().hex
        path = f"{self.root}/data/{commit}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path).withColumn("file", F.col("_metadata.file_path"))
        ranges = [f(c).alias(f"{n}_{c}") for c in self.index for n, f in (("min", F.min), ("max", F.max))]
        rows = stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ranges)
        sizes = self.spark.read.format("binaryFile").load(path).select(F.col("path").alias("of"), F.col("length").alias("bytes"))
        rows = saved(rows.join(sizes, F.col("file") == F.col("of")).drop("of").withColumn("commit", F.lit(commit)), "snapshot-files")
        self._write_blooms(stored, rows, commit)
        return rows

    def _write_blooms(self, stored: DataFrame, files: DataFrame, commit: str) -> None:
        """A filter per file and index column: blocks of bits, as many as the file's rows need.  Bits are or-ed word by
        word where rows are read, in a hash table of fixed-size entries, so no task sorts a row per bit."""
        blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") * BLOOM_BITS / BLOCK_BITS, F.lit(1.0))))).cast("long")
        # files by number (a row per file of one commit): keys of the hash table stay short
        sized = files.select(F.col("file").alias("of"), blocks.alias("blocks"), F.row_number().over(Window.orderBy("file")).alias("number"))
        keyed = stored.join(sized, F.col("file") == F.col("of")).select("number", "blocks", F.explode(F.array(*[
            F.struct(F.lit(i).alias("index"), _bloom_key(F.col(c)).alias("key")) for i, c in enumerate(self.index)])).alias("k")).filter("k.key is not null")
        bits = keyed.select("number", "k.index", F.explode(_places(F.col("k.key"), F.col("blocks"))).alias("place"))
        words = bits.groupBy("number", "index", F.expr(f"place div {WORD_BITS}").alias("word")) \
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(place % {WORD_BITS} as int))")).alias("bits"))
        per_block = BLOCK_BITS // WORD_BITS
        listed = words.groupBy("number", "index", F.expr(f"word div {per_block}").alias("block")) \
            .agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % per_block).cast("int"), "bits"))).alias("words"))
        made = listed.join(sized, "number").select(
            F.col("of").alias("file"), F.element_at(F.array(*[F.lit(c) for c in self.index]), F.col("index") + 1).alias("column"), "blocks", "block",
            F.transform(F.sequence(F.lit(0), F.lit(per_block - 1)), lambda i: F.coalesce(F.col("words")[i], F.lit(0).cast("long"))).alias("bits"))
        made.write.parquet(f"{self.root}/blooms/{commit}")

    def append(self, df: DataFrame, tries: int = 5) -> int:
        """Adds rows as a new snapshot; returns its version.  Another writer's commit in between is kept:
        the manifest is made anew on top of it."""
        new = self._staged(df)
        for left in reversed(range(tries)):
            version = max(self.versions(), default=0)
            old = self.manifest(version) if version else None
            try:
                return self._commit(new if old is None else old.unionByName(new), version + 1)
            except SnapshotConflict:
                if not left:
                    raise
        raise AssertionError

    def cluster_key(self, df: DataFrame, bits: int = CLUSTER_BITS) -> Column:
        """Interleaves the bits of each index column's quantile number; null counts as the lowest.
        The quantiles, 2 ** bits a column, come to the driver."""
        n = 2 ** bits
        shares = [i / n for i in range(1, n)]
        numeric = {c: _numeric(df, c) for c in self.index}
        cuts = df.agg(*[F.percentile_approx(e, shares, 10 * n).alias(c) for c, e in numeric.items()]).first()
        key = F.lit(0).cast("long")
        for i, (c, e) in enumerate(numeric.items()):
            at = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts[c] or []))]), lambda x: x < e))
            for b in range(bits):
                key = key.bitwiseOR(F.shiftleft(F.shiftright(at.cast("long"), b).bitwiseAND(F.lit(1)), b * len(self.index) + i))
        return F.coalesce(key, F.lit(0))

    def compact(self, target_bytes: int = 128 << 20, small: float = 0.5) -> int | None:
        """Rewrites the files below ``small`` of the target as clustered ones of about ``target_bytes``;
        returns the new version, or None with fewer than two such files.  A writer that committed
        meanwhile wins: compaction raises and leaves the table as it is."""
        version = max(self.versions(), default=0)
        if not version:
            return None
        files = self.manifest(version)
        old = saved(files.filter(F.col("bytes") < small * target_bytes), "snapshot-small")
        size = old.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
        if size["n"] < 2:
            return None
        rows = self._rows_of(old)
        parts = max(1, round(size["bytes"] / target_bytes))
        clustered = rows.withColumn("_z", self.cluster_key(rows)).repartitionByRange(parts, "_z", *self.index) \
            .sortWithinPartitions("_z", *self.index).drop("_z")
        new = self._staged(clustered)
        return self._commit(files.join(old.select("file"), "file", "left_anti").select(*files.columns).unionByName(new.select(*files.columns)), version + 1)

    def vacuum(self, keep: int = 1) -> int:
        """Removes manifests before the last ``keep`` and the commits that none of the kept names;
        returns how many commits went.  Readers of older snapshots must be through."""
        versions = self.versions()
        gone = versions[:-keep]
        if not gone:
            return 0
        commits = lambda vs: {r["commit"] for v in vs for r in self.manifest(v).select("commit").distinct().collect()}
        dead = commits(gone) - commits(versions[-keep:])
        for v in gone:
            self._remove(f"{self.root}/manifests/v={v}")
        for c in dead:
            self._remove(f"{self.root}/data/{c}")
            self._remove(f"{self.root}/blooms/{c}")
        return len(dead)

    def _remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    # ------------------------------------------------------------- reading

    def _rows_of(self, files: DataFrame) -> DataFrame:
        """The rows of the listed files: their paths, metadata alone, reach the driver."""
        paths = [r["file"] for r in files.select("file").orderBy("file").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*paths)

    def schema(self) -> T.StructType:
        """Columns of all snapshots' commits, from one file of each commit of the latest."""
        files = self.manifest()
        if files is None:
            return T.StructType([])
        one = [r["file"] for r in files.groupBy("commit").agg(F.min("file").alias("file")).orderBy("file").collect()]
        return self.spark.read.option("mergeSchema", len(one) > 1).parquet(*one).schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot (the latest by default)."""
        return self._rows_of(self.manifest(version))

    def candidates(self, keys: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """The manifest rows of the files that may hold one of ``keys`` (a table of one column, few rows): by
        range first, then by Bloom filter.  A file that holds a key is always among them."""
        files = self.manifest(version)
        wanted = keys.select(F.col(keys.columns[0]).alias("key")).filter("key is not null").distinct()
        low, high = F.col(f"min_{column}"), F.col(f"max_{column}")
        ends = wanted.agg(F.min("key").alias("least"), F.max("key").alias("most")).first()
        if ends["least"] is None:
            return files.limit(0)
        near = files.filter((high >= F.lit(ends["least"])) & (low <= F.lit(ends["most"])))
        commits = [r["commit"] for r in near.select("commit").distinct().collect()]
        if not commits:
            return files.limit(0)
        blooms = self.spark.read.parquet(*[f"{self.root}/blooms/{c}" for c in commits]).filter(F.col("column") == column)
        ranged = near.select(F.col("file").alias("of"), low.alias("low"), high.alias("high"))
        blooms = blooms.join(ranged, F.col("file") == F.col("of"))
        # Filters have a power of two of blocks, so their sizes are few.
        sizes = sorted(r["blocks"] for r in blooms.select("blocks").distinct().collect())
        asked = wanted.select("key", F.explode(F.array(*[F.lit(x).cast("long") for x in sizes])).alias("of_blocks")) \
            .withColumn("places", F.array_distinct(_places(_bloom_key(F.col("key")), F.col("of_blocks"))))
        asked = asked.select("key", "of_blocks", F.size("places").alias("needed"), F.explode("places").alias("place"))
        asked = asked.withColumn("of_block", F.expr(f"place div {BLOCK_BITS}"))
        met = blooms.join(asked, (F.col("blocks") == F.col("of_blocks")) & (F.col("block") == F.col("of_block"))) \
            .filter((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))
        word = F.element_at("bits", F.expr(f"cast((place % {BLOCK_BITS}) div {WORD_BITS} as int) + 1"))
        hit = met.filter(F.getbit(word, (F.col("place") % WORD_BITS).cast("int")) == 1)
        found = hit.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).filter("n = needed")
        return files.join(found.select("file").distinct(), "file", "left_semi")

    def lookup(self, keys: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """The rows whose ``column`` is one of ``keys``.  Up to ``LOOKUP_KEYS`` keys are probed and only files
        that may hold one are opened; more are joined with the whole snapshot."""
        key = keys.columns[0]
        wanted = saved(keys.select(F.col(key).alias("_key")).filter("_key is not null").distinct(), "lookup-keys")
        few = wanted.limit(LOOKUP_KEYS + 1).count() <= LOOKUP_KEYS
        rows = self._rows_of(self.candidates(wanted, column, version)) if few else self.read(version)
        return rows.join(wanted, F.col(column) == F.col("_key"), "left_semi")


def _numeric(df: DataFrame, column: str) -> Column:
    """A column as a number of the same order; a text by its first bytes."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c.cast("string"), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _bloom_key(key: Column) -> Column:
    """A key's hash; a null has none."""
    return F.when(key.isNotNull(), F.xxhash64(key))


def _places(hashed: Column, blocks: Column) -> Column:
    """A key's bits in a filter of so many blocks."""
    return F.array(*[F.pmod(F.xxhash64(hashed, F.lit(i)), blocks * F.lit(BLOCK_BITS)) for i in range(BLOOM_HASHES)])
