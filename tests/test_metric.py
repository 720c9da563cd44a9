"""Nearest vectors by the index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import metric

TERMS = "term_id long, lang string, vector array<float>"


def brute(terms, queries, k):
    out = []
    for q, v, lang in queries:
        if v is None:
            continue
        v, best = np.array(v, np.float32).astype(float), []
        for t, own, w in terms:
            if w is not None and (lang is None or lang == own):
                w = np.array(w, np.float32).astype(float)
                best.append((-(w * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()) + 1e-12), t))
        out += [(q, t, r + 1) for r, (_, t) in enumerate(sorted(best)[:k])]
    return sorted(out)


def clustered(rng, n, dims=8, clusters=12):
    middles = rng.normal(size=(clusters, dims)) * 5
    return [(i, "ab"[i % 2], (middles[i % clusters] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [10_000, 7])
def test_top_k_equals_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    terms = clustered(rng, 600) + [(1000 + i, "a", [1.0] * 8) for i in range(50)]  # copies
    terms += [(2000, "a", [0.0] * 8), (2001, "b", [1e-6] * 8), (2002, "a", None), (2003, None, [2.0] * 8)]
    queries = [(i, terms[i * 7][2], [None, "a", "b"][i % 3]) for i in range(40)] + [(100, [0.0] * 8, None), (101, None, None), (102, [1.0] * 8, "a"), (103, [1.0] * 8, "zz")]
    t = spark.createDataFrame(terms, TERMS).repartition(3)
    q = spark.createDataFrame(queries, "query_id long, qvec array<float>, lang string")
    got = metric.search(metric.build(t, centres=10, page=32), q, 4, block)
    assert sorted((r.query_id, r.term_id, r["rank"]) for r in got.collect()) == brute(terms, queries, 4)


def test_pages_far_away_are_not_compared(spark):
    """On clusters the pairs compared grow with the input, not with its square."""
    rng, share = np.random.default_rng(2), []
    for n in (1000, 4000):
        terms = clustered(rng, n)
        t = spark.createDataFrame(terms, TERMS)
        q = t.where("term_id % 20 = 0").select(F.col("term_id").alias("query_id"), F.col("vector").alias("qvec"), F.lit(None).cast("string").alias("lang"))
        index = metric.build(t, centres=32, page=64)
        compared = metric.found(index, q, 3).agg(F.sum("compared")).first()[0]
        share.append(compared / (n * n / 20))
    assert share[0] < 0.25 and share[1] < 0.25


def test_empty_index_and_no_queries(spark):
    t = spark.createDataFrame([], TERMS)
    q = spark.createDataFrame([(1, [1.0, 2.0], None)], "query_id long, qvec array<float>, lang string")
    assert metric.search(metric.build(t), q).count() == 0
    t = spark.createDataFrame([(1, "a", [1.0, 2.0])], TERMS)
    assert [r.term_id for r in metric.search(metric.build(t), q).collect()] == [1]
    assert metric.search(metric.build(t), q.limit(0)).count() == 0
