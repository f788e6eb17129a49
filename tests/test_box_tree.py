import numpy as np
import pytest

from vardens.operators import box_tree
from vardens.operators.neighbours import knn
from vardens.sources.points import points_from_columns


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    cols = ["a", "b", "c"][: x.shape[1]]
    rows = [(int(i), *map(float, r)) for i, r in zip(ids, x)]
    return points_from_columns(spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)), "id", cols)


def brute(x, ids, k):
    ids = np.asarray(ids)
    d2 = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        d2 = d2 + (x[:, None, c] - x[None, :, c]) ** 2
    out = {}
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, d2[i])) if j != i][:k]
        out.update({(int(ids[i]), r): (int(ids[j]), float(np.sqrt(d2[i, j]))) for r, j in enumerate(order, 1)})
    return out


def answers(df):
    return {(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in df.collect()}


@pytest.fixture
def written(monkeypatch):
    rows = []

    def counting(df, keep=box_tree.checkpoint):
        out = keep(df)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(box_tree, "checkpoint", counting)
    return rows


def test_knn_half_at_one_spot_writes_few_candidates(spark, written):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((1500, 2)), rng.uniform(-1, 1, (1500, 2))])
    ids = rng.permutation(3000) - 700
    got = answers(knn(table(spark, x, ids), 4, hot_rows=100))
    assert got == brute(x, ids, 4)
    assert sum(n for _, n in written) < 100_000


def test_knn_narrow_crowd_writes_few_candidates(spark, written):
    """No two equal points, but half of them within a millionth of the others' spread."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 1e-6, (600, 2)) + 0.3, rng.uniform(-1, 1, (600, 2))])
    got = answers(knn(table(spark, x), 3))
    assert got == brute(x, range(len(x)), 3)
    assert max(n for c, n in written if "ub" in c) < 25 * len(x)


def test_knn_three_dimensions_ties_and_small_tables(spark):
    g = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(3)], float)
    x = np.concatenate([g, g[:7], g[:3]])  # a lattice: many equal distances
    ids = np.arange(len(x))[::-1] * 2
    assert answers(knn(table(spark, x, ids), 5)) == brute(x, ids, 5)
    few = np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 1.0]])  # fewer others than k
    assert answers(knn(table(spark, few), 4)) == brute(few, range(3), 4)
    assert knn(table(spark, few[:1]), 2).count() == 0
    assert knn(table(spark, few).filter("id < 0"), 2).count() == 0
