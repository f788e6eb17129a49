"""Blocks under a packed tree: many partitions, chunks and levels, and what is written and compared."""

import numpy as np
import pytest

from reference_impl import d2_matrix
from test_box_pairs import cores_of, nearest, sizes
from test_box_tree import answers, brute, table
from vardens.operators import box_pairs, box_tree
from vardens.operators.cluster import assign_new
from vardens.operators.neighbours import knn, neighbour_counts


@pytest.fixture
def small_blocks(monkeypatch):
    for module in (box_tree, box_pairs):
        monkeypatch.setattr(module, "RUN_PAIRS", 7)
    for name, value in (("CHUNK", 48), ("PART_ROWS", 150), ("LEAF", 20)):
        monkeypatch.setattr(box_tree, name, value)


def uneven(rng, n):
    """Crowds within crowds, each a thousand times narrower, copies of one place and a lone point."""
    x = [rng.uniform(-1, 1, (n, 2)) * 1000.0**-e + 0.25 for e in range(4)]
    return np.concatenate([*x, np.repeat([[0.5, 0.5]], 9, 0), np.repeat(rng.uniform(-1, 1, (20, 2)), 2, 0), [[400.0, -3.0]]])


def test_searches_over_many_partitions_chunks_and_levels(spark, small_blocks):
    rng = np.random.default_rng(11)
    x = uneven(rng, 150)
    ids = rng.permutation(len(x)) * 3 - 50
    assert answers(knn(table(spark, x, ids), 4, hot_rows=5)) == brute(x, ids, 4)
    radii = [2e-6, 0.4]
    got = {r.id: (r.n0, r.n1) for r in neighbour_counts(table(spark, x), radii, hot_rows=5, leaf=20).collect()}
    assert got == sizes(x, radii)
    cores, labels = x[::2], rng.integers(0, 9, len(x[::2]))
    new = np.concatenate([x[1::2], x[:5], rng.uniform(-1, 1, (60, 2))])
    got = {r.id: r.cluster_id for r in assign_new(cores_of(spark, cores, labels), table(spark, new), 0.01).collect()}
    assert got == nearest(cores, labels, new, 0.01)


def test_uneven_points_take_few_tables(spark, monkeypatch):
    """The number of tables written does not grow with the unevenness (levels are packed)."""
    tables = []

    def counting(df, keep=box_tree.checkpoint):
        tables.append(df.columns)
        return keep(df)

    monkeypatch.setattr(box_tree, "checkpoint", counting)
    x = uneven(np.random.default_rng(12), 400)
    assert answers(knn(table(spark, x), 4)) == brute(x, range(len(x)), 4)
    assert len(tables) <= 8


def test_comparisons_of_counts_and_labels(spark, monkeypatch):
    """Points meet runs across the rim of their circle, and runs near the nearest core, only."""
    compared = []

    def counting(*args, keep=box_pairs._met):
        out = keep(*args)
        compared.append(out.agg({"met": "sum"}).first()[0])
        return out

    monkeypatch.setattr(box_pairs, "_met", counting)
    rng = np.random.default_rng(13)
    for n in (1000, 4000):
        x = rng.uniform(0, 1, (n, 2))
        d2 = d2_matrix(x)
        got = {r.id: r.n0 for r in neighbour_counts(table(spark, x), [0.5]).collect()}
        assert got == {i: int((d2[i] <= 0.25).sum()) for i in range(n)}
    few, many = compared
    assert many / 4000 <= 4 * few / 1000 and many < 0.25 * 4000**2
    cores, new, labels = rng.uniform(0, 0.01, (5000, 2)), rng.uniform(0, 0.01, (5000, 2)), rng.integers(0, 50, 5000)
    got = {r.id: r.cluster_id for r in assign_new(cores_of(spark, cores, labels), table(spark, new), 1.0).collect()}
    assert got == nearest(cores, labels, new, 1.0)
    assert compared[2] < 0.1 * 5000**2


def test_rows_that_share_an_id_and_ids_that_are_null(spark):
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [3.0, 0.0], [9.0, 9.0]])
    t = table(spark, x, [1, 1, 2, 3, 4, 5])
    got = sorted((r.id, r.n0) for r in neighbour_counts(t, [1.5]).collect())
    assert got == [(1, 4), (1, 4), (2, 4), (3, 4), (4, 1), (5, 1)]
    lost = t.selectExpr("nullif(id, 2) as id", "x0", "x1", "valid")
    got = sorted((r.id or 0, r.n0) for r in neighbour_counts(lost, [1.5]).collect())
    assert got == [(0, 4), (1, 4), (1, 4), (3, 4), (4, 1), (5, 1)]
    near = {(r.id, r.rank): r.nbr for r in knn(table(spark, x, range(6)), 2).collect()}
    assert near[(0, 1)] == 1 and near[(0, 2)] == 2 and near[(3, 1)] == 2 and near[(4, 1)] == 2
