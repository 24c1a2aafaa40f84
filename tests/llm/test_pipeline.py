"""The pipeline's stages against brute force, each on its own input."""

import os

import pytest
from brute import brute_secrets, brute_similar, brute_windows, jaccard, shingles

import __spark_entry__ as E
import corpus_pipeline

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no sample data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{HERE}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, HERE).write.parquet(out)
        new = spark.read.parquet(out)
        if name == "encode":
            rows = new.collect()
            assert {r["doc_id"] for r in rows} == set(before) and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in rows)
            break
        assert new.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in new.collect()}
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{HERE}/labels.parquet").filter("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{HERE}/labels.parquet").filter("quality = 1").collect()}
            assert len(bad & set(after)) <= 0.2 * len(bad) + 2 and len(good - set(after)) <= 0.05 * len(good) + 2
        elif name == "dedup":
            root = brute_similar(before.items())
            assert set(after) == set(root.values())
            # by the texts themselves: what links has much in common, what has nearly all in common links
            sets = {i: shingles(t) for i, t in before.items()}
            near = [(i, j, x) for i in before for j in before if i < j and (x := jaccard(sets[i], sets[j])) >= 0.7]
            assert all(root[i] == root[j] for i, j, x in near if x >= 0.93)
            some = {i for pair in near for i in pair[:2]}
            assert all(i in some for i, r in root.items() if i != r)
        elif name == "decontam":
            assert set(after) == {i for i, t in before.items() if not brute_windows(t, bench, 10)[1]}
        else:
            assert set(after) == set(before)
            assert all((after[i] == before[i]) == (not brute_secrets(before[i])) or "[SECRET]" in after[i] for i in after)
        assert all(r["n_chars"] == len(r["text"]) for r in new.collect() if r["text"] is not None) or name != "secrets"
        docs, before = new, after


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{HERE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, HERE)
        assert docs.count() == 0


def test_registered():
    names = E.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
