import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE_ROWS
from vellum.llm import queries, token_files

CONTENT = queries.rank_file(queries.BYTE_LEVEL).decode()
LIBRARY = Tokenizer.from_str(CONTENT)
ENCODER = token_files.Encoder(CONTENT, public_tokenizers.PATTERN, 2)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("ab é'd19.,\n\t  <|>▁　\x1c\x85ñ中")), st.characters(exclude_categories=["Cs"])), max_size=40)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=3), st.sampled_from(["", "<|endoftext|>", " <|endoftext|> x"]))
def test_encoder_is_the_library(texts, special):
    texts = [t + special for t in texts]
    assert [np.frombuffer(p, "<u2").tolist() for p in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_encoder_of_all_kinds():
    texts = ["", " ", "a", " a", "a  b", "a \n b", None, "x" * 3000, "don't  we'll \r\n go", "#2 # #"]
    assert [np.frombuffer(p, "<u2").tolist() for p in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(max_size=6), min_size=1, max_size=300), st.sets(st.text(max_size=6), max_size=50))
def test_perfect_hash(keys, others):
    keys = sorted(keys)
    made = token_files.PerfectHash.of(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    again = token_files.PerfectHash.unpack(made.pack())
    assert again.slots(keys).tolist() == made.slots(keys).tolist()
    assert all(-1 <= s < len(keys) for s in again.slots(sorted(others)).tolist())


def made(docs, **more):
    files, index = token_files.token_files(docs, CONTENT, public_tokenizers.PATTERN, **more)
    found = token_files.lookup(docs.select("doc_id"), "doc_id", index)
    return files, index, found


def crc(text):
    return zlib.crc32(np.array([*ids_of(text), 2], dtype="<u4").tobytes())


def expected(rows):
    """(doc_id, set of crc) in key order; the texts of one key in any order."""
    return sorted(((i is not None, i or 0, len(ids_of(t)) + 1, crc(t)) for i, t, *_ in rows))


def check(docs, rows, **more):
    files, index, found = made(docs, **more)
    got = token_files.keyed_rows(files, found).collect()
    assert sorted((r.key is not None, r.key or 0, r.n_tokens, r.ids_crc32) for r in got) == expected(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order]]).tolist()[:-1]
    assert [(r.key is not None, r.key or 0) for r in order] == sorted((i is not None, i or 0) for i, *_ in rows)
    ids = {}
    for r in token_files.fetch(files, found).collect():
        ids.setdefault(r.key, []).append(list(r.ids))
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*ids_of(t), 2])
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    return files, index


def test_edges(edge, clashing, empty):
    for docs in (edge, clashing):
        check(docs, EDGE_ROWS, shard_bytes=200)
    files, index, found = made(empty)
    assert files.rows.count() == 0 and index.rows.count() == 0 and found.count() == 0
    assert token_files.keyed_rows(files, found).count() == 0


def test_files_hold_raw_ids(spark, edge):
    docs = edge.filter("doc_id in (1, 6, 8, 10)")
    files, _, _ = made(docs, shard_bytes=1 << 20)
    content = [bytes(r.content) for r in spark.read.format("binaryFile").load(files.path).orderBy("path").collect() if r.length]
    flat = [i for c in content for i in token_files.read_shard(c)[0].tolist()]
    by = {r[0]: r[1] for r in EDGE_ROWS}
    assert flat == [x for i in (1, 6, 8, 10) for x in [*ids_of(by[i]), 2]]
    assert content[0][:2] == int(flat[0]).to_bytes(2, "little")


def test_hot_key_and_absent_keys(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("doc_id"),
                                    F.when(F.col("id") % 6 == 0, "same text").otherwise(F.concat(F.lit("text # "), "id")).alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    files, index = check(docs, rows, shard_bytes=4000)
    assert index.buckets > 1 and files.rows.select("shard").distinct().count() > 5
    hot = token_files.lookup(spark.createDataFrame([(7,), (None,), (10 ** 9,)], "k long"), "k", index).collect()
    assert [(r.key, r.rows) for r in hot] == [(7, 1000)]
    absent = spark.range(10 ** 6, 10 ** 6 + 20_000).withColumnRenamed("id", "k")
    assert token_files.lookup(absent, "k", index, asked_keys=64).count() == 0


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "one"), ("a", "two # words"), ("é", None), (None, "")], "doc_id string, text string")
    files, _, found = made(docs)
    got = {r.key: (r.start, r.n_tokens) for r in token_files.keyed_rows(files, found).collect()}
    n = {k: len(ids_of(t)) + 1 for k, t in docs.collect()}
    assert got == {None: (0, n[None]), "a": (n[None], n["a"]), "b": (n[None] + n["a"], n["b"]), "é": (n[None] + n["a"] + n["b"], n["é"])}


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    start, want = 0, []
    for i, t in rows:
        n = len(ids_of(t)) + 1
        want.append((i, start, n, crc(t)))
        start += n
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, sf).collect()) == want
