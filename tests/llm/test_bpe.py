import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import bpe, queries, token_counts
from vellum.llm.queries import rank_file
from tests.llm.conftest import EDGE_ROWS

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_library(text):
    text = text.encode("utf-8", "ignore").decode()
    packed, = CODEC.encode([text])
    assert CODEC.decode(packed) == text.encode()
    assert np.frombuffer(packed, "<u4").tolist() == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "'s't're" * 500, "é" * 3000, "<|endoftext|>", " 　\x1c\x85"])
def test_runs(text):
    packed, = CODEC.encode([text])
    assert np.frombuffer(packed, "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_merge_that_makes_a_lower_pair_is_taken_first():
    # "bc" ranks above "abc", which its merge makes possible: the piece's other "bc" waits.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bcbc": 257, b"bc": 258}
    codec = bpe.Codec(ranks, r".+")
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcbc", "bcbcabc", "abcabcbcbc", "bcabcbcbcabc"):
        assert np.frombuffer(next(codec.encode([text])), "<u4").tolist() == own.encode_ordinary(text)


def test_edges(edge, clashing, empty):
    made = dict(n_tokens="n_tokens", ids="ids", ids_sha256="ids_sha256", decoded_sha256="decoded_sha256")
    for docs in (edge, clashing):
        out = bpe.encode(docs, rank_file(), public_tokenizers.PATTERN, **made)
        assert out.columns == [c for c in docs.columns if c != "text"] + ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
        got = sorted(((r["doc_id"], r["lang"], r["n_chars"], r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()), key=repr)
        expected = []
        for i, t, lang, _, n in EDGE_ROWS:
            ids = REFERENCE.encode_ordinary(t or "")
            expected.append((i, lang, n, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(expected, key=repr)
    assert bpe.encode(empty, rank_file(), public_tokenizers.PATTERN, **made).count() == 0
    clash = bpe.encode(clashing, rank_file(), public_tokenizers.PATTERN, n_tokens="shard")  # the input's column moves
    assert {"shard", "_SHARD"} <= set(clash.columns) and clash.filter("_SHARD = 'extra SHARD' and shard >= 0").count() == len(EDGE_ROWS)


def test_histogram_sums(edge, empty):
    lengths = token_counts.token_lengths(edge.select("source", "text"), rank_file(), public_tokenizers.PATTERN)
    hist = token_counts.histogram(lengths, ["source"]).persist()
    by = {}
    for _, t, _, s, _ in EDGE_ROWS:
        by.setdefault(s, []).append(len(REFERENCE.encode_ordinary(t or "")))
    for r in hist.collect():
        all_, n = by[r["source"]], r["n_tokens"]
        assert r["n_docs"] == all_.count(n) and r["docs_all"] == len(all_) and r["tokens_all"] == sum(all_)
        assert r["docs_at_least"] == sum(x >= n for x in all_) and r["tokens_at_least"] == sum(x for x in all_ if x >= n)
        assert r["share_at_most"] == pytest.approx(sum(x <= n for x in all_) / len(all_))
        assert r["tokens_truncated"] == sum(min(x, n) for x in all_)
    assert sum(r["n_docs"] for r in hist.collect()) == len(EDGE_ROWS)
    for r in token_counts.totals_at(hist, ["source"], [0, 5, 1000]).collect():
        all_ = by[r["source"]]
        assert r["tokens_kept"] == sum(min(x, r["context_limit"]) for x in all_)
        assert r["docs_cut"] == sum(x > r["context_limit"] for x in all_)
    for r in token_counts.quantiles(hist, ["source"], [0.5, 1.0]).collect():
        all_ = sorted(by[r["source"]])
        assert r["n_tokens"] == next(x for x in all_ if sum(y <= x for y in all_) >= r["share"] * len(all_))
    none = token_counts.histogram(token_counts.token_lengths(empty.select("source", "text"), rank_file(), public_tokenizers.PATTERN), [])
    assert none.count() == 0
    assert [tuple(r) for r in token_counts.totals_at(none, [], [10]).collect()] == [(10, 0, 0)]
    assert [tuple(r) for r in token_counts.quantiles(none, [], [0.5]).collect()] == [(0.5, None)]


def test_queries_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    ids = {r.doc_id: REFERENCE.encode_ordinary(r.text or "") for r in docs}
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, sf).collect()}
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in got.items()} == {
        r.doc_id: (len(ids[r.doc_id]), hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs}
    hist = {(r.source, r.n_tokens): r.n_docs for r in queries.op10_token_histogram(spark, sf).collect()}
    assert hist == Counter((r.source, len(ids[r.doc_id])) for r in docs)
