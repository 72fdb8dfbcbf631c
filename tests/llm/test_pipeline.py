from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as p
from stagelight.llm import byte_bpe, mixing, toxicity
from stagelight.llm.common import durable
from tests.llm.test_operators import SMALL, near_components


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The documents before each stage, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        out.append((name, docs))
        docs = durable(stage(spark, docs, sf), name)
    return out, docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_and_rows_of_documents(spark, sf, steps):
    before, _ = steps
    first = before[0][1]
    for (_, a), (_, b) in zip(before, before[1:], strict=False):
        assert b.columns == first.columns and [f.dataType for f in b.schema] == [f.dataType for f in first.schema]
        x, y = rows(a), rows(b)
        assert all(x[i] == y[i] for i in y)


def test_each_stage_by_brute_force(spark, sf, steps):
    inputs = dict(steps[0])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = inputs["toxicity"]
    scores = toxicity.Scorer(toxicity.sample_of(docs.select("doc_id", "text"), labels)).score(docs.select("doc_id", "text"))
    assert {r.doc_id for r in scores.where("score < 0.5").collect()} == set(rows(inputs["exact_dedup"]))
    groups = defaultdict(list)
    for i, r in rows(inputs["exact_dedup"]).items():
        groups[(r.text or "").translate(SMALL)].append(i)
    assert {max(v) for v in groups.values()} == set(rows(inputs["minhash_near_dedup"]))
    near = near_components({i: r.text or "" for i, r in rows(inputs["minhash_near_dedup"]).items()}, words=2)
    assert {i for i, (_, root) in near.items() if i == root} == set(rows(inputs["source_mixing"]))
    mixed = Counter(r.doc_id for r in inputs["byte_bpe"].select("doc_id").collect())
    assert max(mixed.values()) <= 3
    mix = mixing.Mix(inputs["source_mixing"])
    assert {r.doc_id: r.n for r in mix.copies(mix.sizes).selectExpr("doc_id", "size(shards) as n").where("n > 0").collect()} == dict(mixed)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = rows(inputs["byte_bpe"])
    coded = steps[1].collect()
    assert Counter(r.doc_id for r in coded) == mixed
    assert all(list(r.ids) == coder.encode_ordinary(texts[r.doc_id].text or "") and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id].text or "").encode()).hexdigest() for r in coded)


def test_odd_and_empty_tables(spark, edge, empty):
    assert p.run(spark, empty).count() == 0
    assert p.run(spark, edge).count() > 0
