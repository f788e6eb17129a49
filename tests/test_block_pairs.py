"""Pairs of array points by blocks: reduced in the task, never written whole."""

import numpy as np
import pytest

from vardens import session
from vardens.operators import block_pairs as B
from vardens.operators.cluster import dbscan, dbscan_from_pairs
from vardens.operators.neighbours import eps_join_blocked, eps_join_lsh


def _points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], True) for i, v in enumerate(x)], "id long, features array<double>, valid boolean")


@pytest.mark.parametrize("travel", [7, 65_536])
def test_clusters_equal_those_of_the_listed_pairs(spark, monkeypatch, travel):
    monkeypatch.setattr(B, "TRAVEL_ROWS", travel)
    p = _points(spark, np.random.default_rng(5).normal(0, 0.5, (60, 6)))
    pairs = eps_join_blocked(p, 0.9, block_rows=5)
    kept = B.BlockPairs(p, 0.9, block_rows=5)
    want = sorted(tuple(r) for r in dbscan_from_pairs(p, pairs.persist(), 4).collect())
    assert sorted(tuple(r) for r in dbscan_from_pairs(p, kept, 4).collect()) == want


def test_repeated_ids_give_the_rows_of_the_listed_pairs(spark):
    rows = [(1, 0.0), (1, 0.0), (2, 0.1), (3, 0.2), (4, 0.65), (4, 0.65), (5, 3.0)]
    p = spark.createDataFrame([(i, [v, 0.0], True) for i, v in rows], "id long, features array<double>, valid boolean")
    want = sorted(tuple(r) for r in dbscan_from_pairs(p, eps_join_blocked(p, 0.5).persist(), 4).collect())
    assert sorted(tuple(r) for r in dbscan_from_pairs(p, B.BlockPairs(p, 0.5), 4).collect()) == want


def test_a_crowd_of_arrays_writes_no_pairs(spark):
    p = _points(spark, np.random.default_rng(6).normal(0, 0.001, (300, 8)))
    before = len(session._written)
    assert {tuple(r)[1:] for r in dbscan(p, 0.5, 5).collect()} == {("core", 0)}
    assert sum(spark.read.parquet(t).count() for t in session._written[before:]) < 5_000  # 89,700 pairs


def test_lsh_compares_a_pair_once_and_reports_those_that_share_a_bucket(spark):
    x = np.random.default_rng(7).normal(0, 1, (80, 5))
    out = eps_join_lsh(_points(spark, x), 1.0, tables=3, width=0.7, seed=3)
    assert "entry" not in out._jdf.queryExecution().analyzed().toString()  # no row per table and bucket
    got = [(r.src, r.dst) for r in out.collect()]
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    near = {(i, j) for i, j in zip(*np.nonzero(d2 <= 1.0)) if i != j}
    assert len(got) == len(set(got)) and set(got) <= near and len(got) >= 0.5 * len(near)
    assert {(b, a) for a, b in got} == set(got)
