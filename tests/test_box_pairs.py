"""Exact counts and nearest labels by two trees of boxes, against brute force."""

import numpy as np
import pytest

from reference_impl import d2_matrix
from test_box_tree import table
from vardens.operators import box_pairs
from vardens.operators.cluster import assign_new
from vardens.operators.neighbours import neighbour_counts


@pytest.fixture
def met(monkeypatch):
    """How often a location was compared with another, per search."""
    seen = []

    def counting(*args, keep=box_pairs._met):
        out = keep(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(box_pairs, "_met", counting)
    return seen


def sizes(x, radii):
    d2 = d2_matrix(x)
    return {i: tuple(int((d2[i] <= r * r).sum()) for r in radii) for i in range(len(x))}


def nearest(cores, labels, new, eps):
    d2 = np.zeros((len(new), len(cores)))
    for c in range(cores.shape[1]):
        d2 = d2 + (new[:, None, c] - cores[None, :, c]) ** 2
    first = d2.argmin(1)  # the smallest id of those at the smallest distance
    return {i: int(labels[j]) if d2[i, j] <= eps * eps else -1 for i, j in enumerate(first)}


def cores_of(spark, x, labels):
    from pyspark.sql import functions as F

    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "id long, cluster_id long")
    return table(spark, x).join(lab, "id").drop("valid").withColumn("cluster_id", F.col("cluster_id"))


def test_counts_of_crowds_copies_and_a_lattice(spark):
    rng = np.random.default_rng(5)
    lattice = np.array([[i / 4, j / 4] for i in range(8) for j in range(8)])  # distances equal to the radius
    x = np.concatenate([lattice, rng.uniform(0, 1e-6, (80, 2)) + 0.5, np.repeat([[0.25, 0.75]], 60, 0), [[90.0, -7.0]]])
    radii = [0.25, 0.75]
    got = {r.id: (r.n0, r.n1) for r in neighbour_counts(table(spark, x), radii, hot_rows=20, leaf=4).collect()}
    assert got == sizes(x, radii)


def test_counts_in_three_and_one_dimensions_and_small_tables(spark):
    x = np.random.default_rng(6).normal(0, 1, (150, 3))
    got = {r.id: (r.n0,) for r in neighbour_counts(table(spark, x), [0.8], leaf=4).collect()}
    assert got == sizes(x, [0.8])
    got = {r.id: (r.n0,) for r in neighbour_counts(table(spark, x[:, :1]), [0.1]).collect()}
    assert got == sizes(x[:, :1], [0.1])
    few = table(spark, np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert {(r.id, r.n0) for r in neighbour_counts(few, [0.5]).collect()} == {(0, 2), (1, 2)}
    assert neighbour_counts(few.filter("id < 0"), [0.5, 1.0]).columns == ["id", "n0", "n1"]


def test_a_point_is_compared_with_the_rim_of_its_circle_only(spark, met):
    """Four times the points in a cell: at most four times the comparisons of a point."""
    rng = np.random.default_rng(7)
    for n in (1000, 4000):
        x = rng.uniform(0, 1, (n, 2))
        got = {r.id: (r.n0, r.n1) for r in neighbour_counts(table(spark, x), [0.5, 1.0]).collect()}
        assert got == sizes(x, [0.5, 1.0])
    few, many = met
    assert many / 4000 <= 4 * few / 1000 and many < 0.1 * 4000**2


def test_nearest_labels_of_a_hot_cell_are_not_enumerated(spark, met):
    rng = np.random.default_rng(8)
    cores, new = rng.uniform(0, 0.01, (5000, 2)), rng.uniform(0, 0.01, (5000, 2))
    labels = rng.integers(0, 50, 5000)
    got = {r.id: r.cluster_id for r in assign_new(cores_of(spark, cores, labels), table(spark, new), 1.0).collect()}
    assert got == nearest(cores, labels, new, 1.0)
    assert sum(met) < 100 * 5000


def test_nearest_labels_ties_copies_far_points_and_small_tables(spark):
    cores = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0], [1.0, 5.0]])
    labels = [7, 3, 9, 4]
    new = np.concatenate([np.repeat([[1.0, 0.0]], 30, 0), [[1.5, 0.0], [2.0, 0.0], [50.0, 50.0], [0.0, -1.0]]])
    c = cores_of(spark, cores, labels)
    got = {r.id: r.cluster_id for r in assign_new(c, table(spark, new), 1.0, hot_rows=4).collect()}
    assert got == nearest(cores, labels, new, 1.0)
    assert {r.cluster_id for r in assign_new(c.filter("id < 0"), table(spark, new), 1.0).collect()} == {-1}
    assert assign_new(c, table(spark, new).filter("id < 0"), 1.0).count() == 0
