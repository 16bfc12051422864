"""Queries of the training-data operators: op<N>_<name>, production parameters,
whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import alignment, bpe, exact_dedup, hpylm, langid, licenses, merkle, mixing, near_dedup, rules, sharding, token_counts, token_files
from vellum.llm.common import saved
from vellum.sources.tables import table

SHARDS = 16
RANKS = "byte_bpe_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rank_file(name: str = RANKS) -> bytes:
    """Content of a public vocabulary file (under 2 MB), read on the driver."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(documents(spark, sf_dir), "doc_id", "text", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def fold(n: int, rest: int) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves ``rest``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == rest


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~fold(4, 2)))
    return langid.predict(docs.select("doc_id", fold(4, 2).alias("held_out"), "text"), model)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, size, copies, sizes, target = mixing.mix(documents(spark, sf_dir), F.array("source"))
    known = spark.createDataFrame([(s, int(sizes[s]), float(target[s])) for s in mixing.source_order(sizes)],
                                  "name string, source_size long, target double")
    return (rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "left")
            .select("doc_id", F.col(size).alias("size"), "source_size", "target",
                    (F.col(size) * F.col(copies)).alias("taken")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, rank_file(), public_tokenizers.PATTERN, n_tokens="n_tokens", ids_sha256="ids_sha256",
                      decoded_sha256="decoded_sha256")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir), words=3, threshold=85)


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op7_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(documents(spark, sf_dir), fold(7, 2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(rules.statistics(documents(spark, sf_dir).select("doc_id", "text")), "quality-stats")
    learned = rules.fit(stats, table(spark, sf_dir, "labels"))
    failed = rules.base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & rules.verdict(learned)).alias("kept"),
                        rules.fired(learned).alias("rule"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest=True)


def op10_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "text")
    lengths = token_counts.token_lengths(docs, rank_file(), public_tokenizers.PATTERN)
    return token_counts.histogram(lengths, ["source"])


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), rank_file(BYTE_LEVEL).decode(), public_tokenizers.PATTERN, rank_file(PIECES))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(fold(2, 0), F.translate("text", "\n", "")).otherwise(F.col("text"))
    proven = merkle.manifest(documents(spark, sf_dir), fields, [*map(F.col, fields[:-1]), tampered])
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files, index = token_files.token_files(docs, rank_file(BYTE_LEVEL).decode(), public_tokenizers.PATTERN)
    found = token_files.lookup(docs.select("doc_id"), "doc_id", index)
    return token_files.keyed_rows(files, found).withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jump_sharding, op2_language_id, op3_mix_sources, op4_byte_bpe, op5_minhash_near_dedup, op6_license_templates, op7_pitman_yor_lm, op8_quality_rules, op9_exact_dedup, op10_token_histogram,
                           op11_tokenizer_alignment, op12_merkle_manifest, op13_token_files)
}

ORACLES: dict[str, str] = {
    "op1_jump_sharding": """
with recursive crc_table as (
  select list(list_reduce(range(0, 9), lambda c, i: case when i = 0 then c when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) order by b) as entry
  from (select unnest(range(0, 256)) as b)),
docs as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as bytes from documents),
rows as (
  select doc_id, (length(bytes) // 2 + 1)::bigint as size,
    xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::bigint),
        lambda c, b: xor(c // 256, entry[(xor(c, b) % 256) + 1]), 4294967295::bigint), 4294967295::bigint)::bigint as text_crc32
  from docs, crc_table),
keys as (select distinct doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::ubigint::hugeint as key from documents),
jumps(doc_id, n, key, b, j) as (
  select doc_id, n, key, -1::bigint, 0::bigint from keys, (select unnest([16, 17]) as n)
  union all
  select doc_id, n, next, j, floor((j + 1)::double * (2147483648::double / ((next // 8589934592) + 1)::double))::bigint
  from (select *, (key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as next from jumps where j < n)),
landed as (select doc_id, n, max(b) as shard from jumps group by all)
select r.doc_id, r.size, r.text_crc32, 'key' as law, a.shard::integer as shard,
  (row_number() over (partition by a.shard order by md5(concat_ws(',', coalesce(r.doc_id::varchar, ''), r.size::varchar, r.text_crc32::varchar)), r.doc_id) - 1)::bigint as slot,
  g.shard::integer as grown_shard
from rows r join landed a on a.doc_id is not distinct from r.doc_id and a.n = 16
join landed g on g.doc_id is not distinct from r.doc_id and g.n = 17
""",
    "op9_exact_dedup": """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
h as (select doc_id, sha256(norm) as text_sha256, row_number() over (partition by norm, doc_id) as nth, max(doc_id) over (partition by norm) as keep_id,
  count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id and nth = 1) as kept, text_sha256 from h
""",
    "op12_merkle_manifest": """
with recursive crc_table as (
  select list(list_reduce(range(0, 9), lambda c, i: case when i = 0 then c when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) order by b) as entry
  from (select unnest(range(0, 256)) as b)),
ids as (select distinct doc_id, hex(encode(coalesce(doc_id::varchar, ''))) as bytes from documents),
crc as (
  select doc_id, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::bigint),
    lambda c, b: xor(c // 256, entry[(xor(c, b) % 256) + 1]), 4294967295::bigint), 4294967295::bigint)::bigint as crc from ids, crc_table),
docs as (
  select documents.doc_id, source, coalesce('+' || source, '') as key, text,
    concat(coalesce(strlen(documents.doc_id::varchar) || ':' || documents.doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
    case when crc % 2 = 0 then replace(text, chr(10), '') else text end as trial
  from documents join crc on documents.doc_id is not distinct from crc.doc_id),
leaves as (
  select doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(trial) || ':' || trial, '-')) as trial from docs),
placed as (
  select *, row_number() over (partition by key order by doc_id nulls first, leaf, trial) - 1 as pos, count(*) over (partition by key) as n from leaves),
nodes(key, lvl, pos, n, h) as (
  select key, 0, pos, n, leaf from placed
  union all
  select key, lvl + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by key, lvl, pos // 3),
subroots as (select key, h, row_number() over (order by key) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops(lvl, pos, n, h) as (
  select 0, pos, n, h from subroots
  union all
  select lvl + 1, pos // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by lvl, pos // 3),
sibs as (
  select a.key, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from nodes a join nodes b on a.key = b.key and a.lvl = b.lvl and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
top_sibs as (
  select a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from tops a join tops b on a.lvl = b.lvl and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
up(key, place, lvl, pos, n, h, proof) as (
  select key, pos, 0, pos, n, trial, '' from placed
  union all
  select up.key, up.place, up.lvl + 1, up.pos // 3, (up.n + 2) // 3, sha256(s.l || up.h || s.r), up.proof || s.l || s.r
  from up join sibs s on up.key = s.key and up.lvl = s.lvl and up.pos = s.pos where up.n > 1),
climb(key, place, subroot, lvl, pos, n, h, proof) as (
  select up.key, up.place, s.h, 0, s.pos, s.n, up.h, up.proof from up join subroots s using (key) where up.n = 1
  union all
  select o.key, o.place, o.subroot, o.lvl + 1, o.pos // 3, (o.n + 2) // 3, sha256(s.l || o.h || s.r), o.proof || s.l || s.r
  from climb o join top_sibs s on o.lvl = s.lvl and o.pos = s.pos where o.n > 1)
select p.doc_id, p.leaf, o.subroot, t.h as root, sha256(o.proof) as proof_sha256, o.h as folded_root, o.h = t.h as verified
from placed p join climb o on p.key = o.key and p.pos = o.place and o.n = 1 join tops t on t.n = 1
""",
}
