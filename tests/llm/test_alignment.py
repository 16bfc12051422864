import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE_ROWS, rows_of
from vellum.llm import alignment, lexicon, queries

BYTE_LEVEL = queries.rank_file(queries.BYTE_LEVEL).decode()
PIECES = queries.rank_file(queries.PIECES)
PAIR = alignment.Pair(BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)
A = Tokenizer.from_str(BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=PIECES)

TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("ab é'd19.,\n\t  <|>▁　\x1c\x85ñ中")), st.characters(exclude_categories=["Cs"])), max_size=40)


def whole(text):
    """(A ids, B ids, links, groups as text) of a whole text, token by token."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sides = [PAIR.a.bytes_of[i] for i in a], [PAIR.b_bytes[i] for i in b]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    spans = []
    for side in sides:
        ends = np.cumsum([len(t) for t in side]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if max(s, u) < min(e, v)]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for cut in cuts:
        inside = [",".join(str(i) for i, (s, e) in zip(ids, span) if start <= s and e <= cut) for ids, span in zip((a, b), spans)]
        groups.append("|".join(inside))
        start = cut
    return a, b, links, ";".join(groups)


def brute(rows):
    made = [whole(r[1]) for r in rows]
    counts = Counter(p for m in made if m for p in set(m[2]))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for r, m in zip(rows, made):
        if not m:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = m
        out.append((r[0], len(a), len(b), groups.count(";") + 1, len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_chunks_are_the_whole(text):
    words, at, lengths = lexicon.chunks(pa.array(["x y", text, None]).slice(1))
    words = words.to_pylist()
    assert lengths.tolist() == [len(at), 0] and " ".join(words[i] for i in at.tolist()) == text
    a = [i for k in at.tolist() for i in PAIR.a.encode(" " + words[k])]
    assert a == A.encode(" " + text, add_special_tokens=False).ids
    expected = whole(text)
    made = PAIR.align(words)
    if expected is None:
        assert not text or not made["good"].all()
    else:
        cut = np.cumsum(made["links"][1])
        links = [made["links"][0][e - n:e].tolist() for e, n in zip(cut, made["links"][1])]
        assert [x for k in at.tolist() for x in links[k]] == [x * alignment.B_IDS + y for x, y in expected[2]]
        assert ";".join(made["groups"][k] for k in at.tolist()) == expected[3]


def align(docs, **more):
    return alignment.align(docs, BYTE_LEVEL, public_tokenizers.PATTERN, PIECES, **more)


def test_edges(edge, clashing, empty):
    expected = brute([r for r in EDGE_ROWS if r[0] != 7])
    for docs in (edge, clashing):
        assert rows_of(align(docs.filter("doc_id <> 7 or doc_id is null"))) == expected
    assert align(empty).count() == 0


def test_long_text_and_short_runs(edge):
    assert rows_of(align(edge, run_bytes=100)) == rows_of(align(edge))


def test_unfaithful_texts_have_no_tokens(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, "a ▁ b"), (3, "plain words"), (4, "<|endoftext|> plain words")], "doc_id long, text string")
    got = {r.doc_id: r for r in align(docs).collect()}
    assert got[2].n_a == 0 and got[2].groups_sha256 == "" and got[1].n_a == 2
    assert rows_of(align(docs)) == brute([tuple(r) for r in docs.collect()])


def test_hot_text_weighs_as_often_as_it_stands(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the harbour wall").otherwise(F.concat(F.lit("the harbour "), "id")).alias("text"))
    assert rows_of(align(docs)) == brute([tuple(r) for r in docs.collect()])


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 3000]  # the brute force is quadratic: long texts are checked by n_a
    got = {r.doc_id: r for r in queries.op11_tokenizer_alignment(spark, sf).collect()}
    assert len(got) == 200
    for i, text in rows:
        m = whole(text)
        if m:
            assert (got[i].n_a, got[i].n_b, got[i].n_links) == (len(m[0]), len(m[1]), len(m[2]))
            assert got[i].groups_sha256 == hashlib.sha256(m[3].encode()).hexdigest()


def test_vocabularies_beyond_a_pair(monkeypatch):
    monkeypatch.setattr(alignment, "B_IDS", 100)
    with pytest.raises(ValueError):
        alignment.Pair(BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)
