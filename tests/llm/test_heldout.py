"""Held-out accuracy of the trained models, recall of the index."""

import numpy as np
import pytest

from slidelake.llm import queries

SF = "/root/testdata/sf0.01"


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = score.argsort(kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality", "quality", 0.95), ("op2_toxicity", "toxic", 0.8)])
def test_held_out(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.doc_id.is_unique
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least


def test_lm_beats_the_base_on_held_out_text(spark):
    got = queries.QUERIES["op8_lm_score"](spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_recall(spark):
    got = queries.QUERIES["op10_nearest"](spark, SF).toPandas()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(v.embedding.tolist(), float)
    hit = 0
    for q, found in got.groupby("query_id").vec_id:
        s = x @ x[v.vec_id == q][0]
        s[(v.vec_id == q).to_numpy()] = -np.inf
        hit += len(set(v.vec_id.to_numpy()[np.argsort(-s)[:20]]) & set(found))
    assert hit / len(got) >= 0.9
