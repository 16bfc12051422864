"""Token ids as raw binary files, with a minimal perfect hash index over document keys.

Files.  A shard file holds the ids of consecutive documents in ascending key order, as
little-endian unsigned integers of 2 bytes (4 for larger vocabularies), each document
followed by the end id; then a directory (an Arrow stream: key, number of ids) and a
trailer (magic, width, number of documents, ids, directory bytes).  Files in name order are
the corpus.  They are written and read by Spark's own file writers and readers, so
they can stand in any store that Spark reaches: every document is one line of the
text writer, and the line end is the end id.

Writing.  Rows are dealt by ranges of (key, text), so that one key with a third
of all rows spreads over many shards, sorted within their shard and encoded in that
order; nothing but the rows being encoded is held.

Index.  Keys are dealt over buckets by hash, about 1000 distinct keys each.  Within a
bucket a minimal perfect hash gives each key a slot of its own: level by level keys
are hashed into a bit table of 1.5 bits a key left; a key alone in its bit is
placed, the others go on to the next level; a key's slot is the rank of its bit.
A slot stores the key's 32-bit fingerprint, the shard, the offset of its first row in
that shard, the ordinal of that row in the corpus, and the number of its rows and ids.
A lookup reads one bucket and one slot, compares no keys and touches no others; a key that isn't there
is told by the fingerprint (a wrong hit once in four billion).

Defined cases: a null text is empty and has the end id only; a null key is a key,
before all others; rows that repeat a key stand side by side, in the order of their
text, and the index names their range.  An empty table gives no files and no index.
Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from vellum.llm.common import fresh, repeated, runs, saved
from vellum.llm.lexicon import ByteBpe, Lexicon, chunks, first_chunks, ragged
from vellum.plans.prefix import prefix_sums
from vellum.session import scratch_path, ship_code

END_ID = 2
SHARD_BYTES = 1 << 24  # text bytes of a shard, about
RUN_BYTES = 1 << 20
BUCKET_KEYS = 1024
# Chunks a task remembers, about 40 bytes each: a bound of memory, not of input.
REMEMBERED = 1_200_000
SPREAD = 1.5  # bits of a level for each key left

_MAGIC = b"TOKSHARD"
_TRAILER = "<8sIQQQ"
_TRAILER_BYTES = struct.calcsize(_TRAILER)
_ENTRY = np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("ordinal", "<i8"), ("rows", "<i8"), ("ids", "<i8")])
_DIRECTORY = "shard long, nth long, offset long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of texts, each distinct chunk encoded once."""

    def __init__(self, content: str, pattern: str, width: int):
        self.bpe = ByteBpe(content, pattern, special=True)
        self.dtype = np.dtype(f"<u{width}")
        self.lexicon = Lexicon(self._make, REMEMBERED)

    def _make(self, words: list[str]) -> dict:
        ids = [self.bpe.encode(" " + w) for w in words]
        return {"ids": (np.array([i for x in ids for i in x], dtype=self.dtype), np.array([len(x) for x in ids], dtype=np.int64))}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's packed ids.  The first chunk has no space before it."""
        heads, rests = first_chunks([t or "" for t in texts])
        words, at, lengths = chunks(pa.array(rests, type=pa.string()))
        flat, sizes = self.lexicon.row_values("ids", self.lexicon.codes(words))
        starts = np.cumsum(sizes) - sizes
        packed = flat[ragged(starts[at], sizes[at])].astype(self.dtype).tobytes()
        per_text = np.cumsum(np.concatenate([[0], sizes[at]]))[np.concatenate([[0], np.cumsum(lengths)])] * self.dtype.itemsize
        cut = per_text.tolist()
        return [np.array(self.bpe.encode(h), dtype=self.dtype).tobytes() + packed[i:j] for h, i, j in zip(heads, cut, cut[1:])]


@lru_cache(maxsize=1)
def _encoder(content: str, pattern: str, width: int) -> Encoder:
    return Encoder(content, pattern, width)


def _directory(keys: list[pa.Array], counts: list[int]) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.table({"key": pa.chunked_array(keys), "n_tokens": pa.array(counts, type=pa.int64())})
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def read_shard(content: bytes) -> tuple[np.ndarray, pa.Table]:
    """A shard file's ids and its directory."""
    magic, width, n_docs, n_ids, n_bytes = struct.unpack_from(_TRAILER, content, len(content) - _TRAILER_BYTES - _line_end(content))
    if magic != _MAGIC:
        raise ValueError("not a shard file")
    start = n_ids * width
    table = pa.ipc.open_stream(pa.BufferReader(content[start:start + n_bytes])).read_all()
    if table.num_rows != n_docs:
        raise ValueError("the directory doesn't fit the file")
    return np.frombuffer(content, dtype=f"<u{width}", count=n_ids), table


def _line_end(content: bytes) -> int:
    """The trailer is a line of its own; its end is as wide as an id."""
    return next(w for w in (2, 4) if content[-_TRAILER_BYTES - w:][:len(_MAGIC)] == _MAGIC)


@dataclass
class TokenFiles:
    """Where the shard files stand, and what was read from them: a row per document
    (``key``, ``shard``, ``nth`` in the shard, ``offset`` in the shard, ``ordinal`` and ``start``
    in the corpus, ``n_tokens``, ``ids_crc32``)."""

    path: str
    rows: DataFrame


def write(docs: DataFrame, content: str, pattern: str, path: str, doc_id: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> None:
    """Shard files of ``docs`` below ``path``.  ``content`` is the tokenizer's file, of fixed size."""
    spark = docs.sparkSession
    ship_code(spark)
    width = 2 if Tokenizer.from_str(content).get_vocab_size() <= 1 << 16 else 4
    slim = docs.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text"))
    held = spark.sparkContext.broadcast((content, pattern, width))
    size = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # Repeated rows are alike; a number of their own lets ranges cut between them.
    order = [F.col("key"), F.xxhash64("text"), F.col("row")]
    dealt = (slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // shard_bytes)), *order)
             .sortWithinPartitions(*order).select("key", "text"))
    end = end_id.to_bytes(width, "little")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*held.value)
        keys, counts = [], []
        for batch in batches:
            texts = batch.column(1)
            for start, n in runs(texts, RUN_BYTES):
                packed = encoder.encode(texts.slice(start, n).to_pylist())
                keys.append(batch.column(0).slice(start, n))
                counts += [len(p) // width + 1 for p in packed]
                yield pa.RecordBatch.from_arrays([pa.array(packed, type=pa.binary())], names=["value"])
        if counts:
            directory = _directory(keys, counts)
            tail = directory + struct.pack(_TRAILER, _MAGIC, width, len(counts), sum(counts), len(directory))
            yield pa.RecordBatch.from_arrays([pa.array([tail], type=pa.binary())], names=["value"])

    lines = dealt.mapInArrow(make, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", end.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read(spark: SparkSession, path: str, key: T.DataType) -> TokenFiles:
    """The documents in the files below ``path``; ``key`` is the type of their ids."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    numbered = saved(prefix_sums(listed, ["name"], []).select("name", (F.col("rows_cum") - 1).alias("shard")), "token-shards")
    schema = T.StructType([T.StructField("key", key), *T.StructType.fromDDL(_DIRECTORY.replace("shard long", "name string")).fields])
    kind = to_arrow_type(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, directory = read_shard(batch.column(1)[i].as_py())
                counts = directory.column("n_tokens").to_numpy()
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([
                    directory.column("key").combine_chunks().cast(kind), pa.array([batch.column(0)[i].as_py()] * n, type=pa.string()),
                    pa.array(np.arange(n)), pa.array(ends - counts), pa.array(counts), pa.array(crcs, type=pa.int64())], names=schema.names)

    found = saved(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(scan, schema), "token-rows")
    sizes = found.groupBy("name").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("docs")).join(numbered, "name")
    bases = saved(prefix_sums(sizes, ["shard"], ["ids", "docs"])
                  .select("name", "shard", (F.col("ids_cum") - F.col("ids")).alias("ids_before"), (F.col("docs_cum") - F.col("docs")).alias("docs_before")), "token-bases")
    rows = found.join(bases, "name").select(
        "key", "shard", "nth", "offset", (F.col("docs_before") + F.col("nth")).alias("ordinal"),
        (F.col("ids_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    return TokenFiles(path, rows)


# --- the index

def key_text(key: Column) -> Column:
    """A key as text; null is the empty text, no other key is."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")


def _hashes(keys: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], dtype=np.uint64)


def _mix(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the same keys for each level (a 64-bit finaliser)."""
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: a bit table a level."""

    def __init__(self, seed: int, levels: list[np.ndarray]):
        self.seed, self.levels = seed, levels
        self.ranks = [np.cumsum(bits) for bits in levels]
        self.before = np.cumsum([0, *[int(r[-1]) for r in self.ranks]]).tolist()

    @classmethod
    def of(cls, keys: list[str]) -> "PerfectHash":
        seed = 0
        while len(np.unique(hashes := _hashes(keys, seed))) < len(keys):
            seed += 1
        levels = []
        while len(hashes):
            size = max(1, int(SPREAD * len(hashes)))
            at = (_mix(hashes, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            hashes = hashes[~bits[at]]
        return cls(seed, levels)

    def slots(self, keys: list[str]) -> np.ndarray:
        """Each key's slot; for a key that wasn't hashed any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, hashes = np.arange(len(keys)), _hashes(keys, self.seed)
        for level, bits in enumerate(self.levels):
            at = (_mix(hashes, level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]] - 1
            left, hashes = left[~hit], hashes[~hit]
        return out

    def pack(self) -> bytes:
        head = struct.pack("<QI", self.seed, len(self.levels)) + struct.pack(f"<{len(self.levels)}Q", *map(len, self.levels))
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, raw: bytes) -> "PerfectHash":
        seed, n = struct.unpack_from("<QI", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 12)
        at, levels = 12 + 8 * n, []
        for size in sizes:
            held = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=held, offset=at), count=size).astype(bool))
            at += held
        return cls(seed, levels)


def fingerprints(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(k, 0x5EED) for k in keys], dtype=np.uint32)


def _build(table: pa.Table) -> pa.Table:
    """One bucket's hash and slots."""
    keys = table.column("key").to_pylist()
    made = PerfectHash.of(keys)
    entries = np.zeros(len(keys), dtype=_ENTRY)
    slots = made.slots(keys)
    entries["print"][slots] = fingerprints(keys)
    for name in _ENTRY.names[1:]:
        entries[name][slots] = table.column(name).to_numpy()
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "hash": pa.array([made.pack()], type=pa.binary()),
                     "slots": pa.array([entries.tobytes()], type=pa.binary())})


@dataclass
class Index:
    """A row a bucket: its perfect hash and its slots."""

    rows: DataFrame
    buckets: int


def build_index(files: TokenFiles, bucket_keys: int = BUCKET_KEYS) -> Index:
    """The index of all documents in the files; keys of many rows are counted before they meet."""
    ship_code(files.rows.sparkSession)
    first = F.min(F.struct("ordinal", "shard", "offset")).alias("first")
    keys = files.rows.groupBy(key_text(F.col("key")).alias("key")).agg(first, F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("ids"))
    keys = saved(keys.select("key", "first.*", "rows", "ids"), "token-keys")
    buckets = max(1, -(-keys.count() // bucket_keys))
    built = keys.withColumn("bucket", _bucket(F.col("key"), buckets)).groupBy("bucket").applyInArrow(_build, "bucket long, hash binary, slots binary")
    return Index(saved(built, "token-index"), buckets)


def lookup(keys: DataFrame, key: str, index: Index, asked_keys: int = 4 * BUCKET_KEYS) -> DataFrame:
    """For each distinct ``key`` that the index holds: ``shard``, ``offset``, ``ordinal``, ``rows``, ``ids``.

    Distinct keys go to their bucket in portions of about ``asked_keys``."""
    ship_code(keys.sparkSession)
    kind = keys.schema[key].dataType
    asked = saved(keys.select(F.col(f"`{key}`").alias("key")).distinct().withColumn("text", key_text(F.col("key"))), "token-asked")
    portions = max(1, -(-asked.count() // (index.buckets * asked_keys)))
    dealt = (asked.withColumn("bucket", _bucket(F.col("text"), index.buckets)).withColumn("portion", F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(portions)))
             .groupBy("bucket", "portion").agg(F.collect_list(F.struct("key", "text")).alias("asked")))
    schema = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL("shard long, offset long, ordinal long, rows long, ids long").fields])
    arrow_kind = to_arrow_type(kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = [a["text"] for a in row["asked"]]
                entries = np.frombuffer(row["slots"], dtype=_ENTRY)
                slots = PerfectHash.unpack(row["hash"]).slots(texts)
                hit = np.flatnonzero((slots >= 0) & (entries["print"][slots] == fingerprints(texts)))
                found = entries[slots[hit]]
                ids = pa.array([row["asked"][i]["key"] for i in hit.tolist()], type=arrow_kind)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(found[n].copy()) for n in _ENTRY.names[1:]]], names=schema.names)

    return saved(dealt.join(index.rows, "bucket").select("asked", "hash", "slots").mapInArrow(find, schema), "token-found")


def fetch(files: TokenFiles, found: DataFrame) -> DataFrame:
    """(``key``, ``nth``, ``ids``) of the rows that a lookup found: each shard's wanted ranges meet
    its file, whose payload is cut at their offsets."""
    spark = found.sparkSession
    ship_code(spark)
    one, = fresh(found, "nth")
    wanted = repeated(found.select("key", "ordinal", "rows"), "rows", one)
    places = files.rows.select(F.col("ordinal").alias("at"), "shard", "offset", "n_tokens")
    wanted = (wanted.join(places, F.col("ordinal") + F.col(one) == F.col("at"))
              .groupBy("shard").agg(F.collect_list(F.struct("key", F.col(one).alias("nth"), "offset", "n_tokens")).alias("wanted")))
    names = spark.read.format("binaryFile").load(files.path).filter("length > 0")
    listed = prefix_sums(names.select(F.element_at(F.split("path", "/"), -1).alias("name")), ["name"], []).select("name", (F.col("rows_cum") - 1).alias("shard"))
    content = names.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    met = wanted.join(listed, "shard").join(content, F.col("name") == F.col("file")).select("wanted", "content")
    kind = found.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("nth", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _ = read_shard(batch.column(1)[i].as_py())
                asked = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([a["key"] for a in asked], type=to_arrow_type(kind)), pa.array([a["nth"] for a in asked], type=pa.int64()),
                    pa.array([ids[a["offset"]:a["offset"] + a["n_tokens"]].astype(np.int64) for a in asked], type=pa.list_(pa.int64()))], names=schema.names)

    return met.mapInArrow(cut, schema)


def keyed_rows(files: TokenFiles, found: DataFrame) -> DataFrame:
    """A row per document of the keys found: ``key``, ``start``, ``n_tokens``, ``ids_crc32``, as the
    files have them at the ordinals that the index names."""
    at, = fresh(found, "at")
    wanted = repeated(found.select("key", "ordinal", "rows"), "rows", at)
    wanted = wanted.select("key", (F.col("ordinal") + F.col(at)).alias("ordinal"))
    return wanted.join(files.rows.drop("key"), "ordinal").select("key", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, content: str, pattern: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> tuple[TokenFiles, Index]:
    """Files written below ``path`` (by default a fresh folder in the shared one), read back and indexed."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write(docs, content, pattern, path, doc_id, text, shard_bytes, end_id)
    files = read(docs.sparkSession, path, docs.schema[doc_id].dataType)
    return files, build_index(files)
