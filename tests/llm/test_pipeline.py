import hashlib
import re
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from vellum.llm import bpe
from vellum.llm.common import saved
from tests.llm.conftest import EDGE_ROWS
from tests.llm.test_near_dedup import brute as near_brute


def lower(t):
    return (t or "").encode().lower().decode()


def test_registered():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [q for q in queries if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert queries["pipeline"] is corpus_pipeline.run and "pipeline" not in oracles
    assert set(oracles) <= set(queries)


def check_stages(spark, docs, sf):
    """Each stage against a plain computation on its own input."""
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in rows.collect()]
        out = saved(stage(spark, rows, sf), "test-stage")
        after = [tuple(r) for r in out.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            if name != "language_id":
                assert not Counter(after).keys() - Counter(before).keys()
        if name == "language_id":
            # only rows without a letter go; languages may be put right, nothing else changes
            bare = lambda rows: Counter((r[0], r[1], *r[3:]) for r in rows)
            assert bare(after) == bare([r for r in before if any(c.isalpha() for c in r[1] or "")])
            assert all(r[2] is not None for r in after) or not any(r[2] for r in before)
        elif name == "exact_dedup":
            best = defaultdict(list)
            for r in before:
                best[lower(r[1])].append(r[0])
            expected = {k: max((i for i in v if i is not None), default=None) for k, v in best.items()}
            assert sorted(((lower(r[1]), r[0]) for r in after), key=repr) == sorted(expected.items(), key=repr)
        elif name == "near_dedup":
            kept = [r for r in near_brute([r[:2] for r in before], 5, 80) if r[3]]
            assert sorted((r[0] for r in after), key=repr) == sorted((r[0] for r in kept), key=repr)
        elif name == "mix_sources":
            times = Counter(r[:2] for r in after)
            assert max(times.values(), default=0) <= 2
            words = lambda x: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in x)
            # Off by less than the longest document, which is taken as a whole.
            assert abs(words(after) - 1.5 * words(before)) <= 0.01 * words(before) + max((words([r]) for r in before), default=0)
        else:
            codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
            got = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in out.collect()), key=repr)
            assert got == sorted(((r[0], tuple(codec.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before), key=repr)
            assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in out.collect())
        rows = out
    return rows


def test_stages_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    last = check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, last.collect()))


def test_edges(spark, edge, empty):
    check_stages(spark, edge, "")  # null ids too
    out = check_stages(spark, edge.select("*", F.lit(1).alias("extra")), "")
    assert "extra" in out.columns
    clash = edge.select("*", F.lit(1).alias("ids"), F.lit("x").alias("decoded_sha256"))
    assert check_stages(spark, clash, "").filter("_ids = 1 and _decoded_sha256 = 'x' and size(ids) >= 0").count() > 0
    assert check_stages(spark, empty, "").count() == 0
    assert len(EDGE_ROWS) == edge.count()
