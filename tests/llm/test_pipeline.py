"""The registered queries against brute-force versions and their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from landfold.llm import mixing, quality_model, registry
from landfold.llm.bpe import vocabulary_path
from landfold.llm.common import DOCUMENT_COLUMNS, table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {name} AS FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, con, name):
    got = registry.queries()[name](spark, DIR)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in at) for r in want.fetchall())


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_op9(spark, con):
    docs = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    total = sum(len(x.encode()) + 8 for _, x in docs)
    below, slots, want = 0, Counter(), {}
    for i, x in docs:
        shard = 24 * below // total
        want[i] = (len(x.encode()) + 8, zlib.crc32(x.encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
        below += len(x.encode()) + 8
    assert {r[0]: tuple(r[1:]) for r in registry.queries()["op9_byte_shards"](spark, DIR).collect()} == want


def test_op5_accuracy(spark):
    big = "/root/testdata/sf0.01"
    got = registry.queries()["op5_quality_model"](spark, big)
    seen = got.join(table(spark, big, "labels"), "doc_id")
    assert got.count() == table(spark, big, "documents").count()
    right = seen.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.9


def test_op4_leaves_clean_documents_alone(spark, con):
    docs = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in registry.queries()["op4_feistel_pseudonyms"](spark, DIR).collect():
        assert (r.text == docs[r.doc_id]) == (r.n_private == 0)


def test_pipeline_on_odd_rows(spark, clashing, empty, tmp_path):
    """Nulls, repeated rows and ids, long texts, other people's columns, an empty table: each stage takes what the last one
    left, keeps its columns, and no text is lost but by a stage's own decision."""
    stages = dict(corpus_pipeline.STAGES)
    table(spark, DIR, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    texts = [{r.text or "" for r in docs.collect()}]
    for name in ("quality classifier", "exact dedup", "near dedup", "mixing"):
        docs = stages[name](spark, docs, str(tmp_path)).cache()
        assert docs.columns == clashing.columns
        found = docs.collect()
        texts.append({r.text or "" for r in found})
        if name in ("exact dedup", "near dedup"):
            assert len(found) == len(texts[-1])
    assert texts[2] == texts[1] and texts[3] <= texts[2] and texts[4] <= texts[3]
    assert stages["bpe"](spark, docs, str(tmp_path)).count() == docs.count()
    nothing = empty
    for name in stages:
        nothing = stages[name](spark, nothing, str(tmp_path))
        assert nothing.count() == 0


def test_pipeline_again_gives_the_same(spark):
    docs = table(spark, DIR, "documents")
    stage = dict(corpus_pipeline.STAGES)["exact dedup"]
    once, twice = (Counter(r.doc_id for r in stage(spark, docs, DIR).collect()) for _ in range(2))
    assert once == twice and len(once) > 0


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "bpe"]
    good = stages["quality classifier"](spark, docs, DIR)
    scores = quality_model.score(docs, quality_model.train(docs, labels))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect() if r._lf_score >= 0.3}
    one = stages["exact dedup"](spark, good, DIR)
    groups = defaultdict(list)
    for r in good.collect():
        groups[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(map(max, groups.values()))
    near = stages["near dedup"](spark, one, DIR)
    from tests.llm.test_operators import brute_components, slow_fingerprint

    want = {c for _, _, c in brute_components([(r.doc_id, slow_fingerprint(r.text)) for r in one.collect()])}  # ids are unique here
    assert sorted(r.doc_id for r in near.collect()) == sorted(want)
    mixed = stages["mixing"](spark, near, DIR)
    rows, cuts = mixing.plan_mixture(near, mixing.Mixture())
    copies = {r.doc_id: r._lf_copies for r in mixing.with_copies(rows, cuts, mixing.Mixture()).collect() if r._lf_copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies)
    for stage in (good, one, near, mixed):
        assert tuple(stage.columns) == DOCUMENT_COLUMNS
    library = Tokenizer.from_file(vocabulary_path())
    texts = {r.doc_id: r.text for r in near.collect()}
    out = corpus_pipeline.run(spark, DIR).collect()
    assert Counter(r.doc_id for r in out) == Counter(copies)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
