import numpy as np
import pytest

from reference_impl import d2_matrix
from vardens.operators.density import assign_level, density_levels, exact_quantiles, k_distance
from vardens.operators.neighbours import eps_join_blocked, eps_join_grid, knn, neighbour_counts
from vardens.sources.points import points_from_array, points_from_columns


def blob(spark, n=160, seed=1, dup=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.2, (n // 2, 2)), rng.normal(1, 0.6, (n - n // 2, 2))])
    if dup:
        x = np.concatenate([x, np.repeat(x[:1], dup, 0)])
    ids = np.arange(len(x)) * 3 + 1
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x)], "id long, a double, b double")
    return points_from_columns(df, "id", ["a", "b"]), ids, x


@pytest.mark.parametrize("hot_rows", [2_000_000, 5])
def test_eps_join_grid(spark, hot_rows):
    p, ids, x = blob(spark, dup=20)
    got = {(r["src"], r["dst"]) for r in eps_join_grid(p, 0.25, hot_rows=hot_rows).collect()}
    d2 = d2_matrix(x)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in range(len(x)) if i != j and d2[i, j] <= 0.0625}
    assert got == want


@pytest.mark.parametrize("hot_rows", [2_000_000, 5])
def test_neighbour_counts(spark, hot_rows):
    p, ids, x = blob(spark, dup=40)
    got = {r["id"]: (r["n0"], r["n1"]) for r in neighbour_counts(p, [0.2, 0.45], hot_rows=hot_rows, leaf=4).collect()}
    d2 = d2_matrix(x)
    want = {int(ids[i]): (int((d2[i] <= 0.04).sum()), int((d2[i] <= 0.45 * 0.45).sum())) for i in range(len(x))}
    assert got == want


def test_knn_exact_with_outliers(spark):
    p, ids, x = blob(spark)
    extra = spark.createDataFrame([(100001, 40.0, 40.0), (100002, -30.0, 5.0)], "id long, a double, b double")
    p = p.unionByName(points_from_columns(extra, "id", ["a", "b"]))
    ids = np.concatenate([ids, [100001, 100002]])
    x = np.concatenate([x, [[40.0, 40.0], [-30.0, 5.0]]])
    got = {(r["id"], r["rank"]): (r["nbr"], round(r["dist"], 9)) for r in knn(p, 3).collect()}
    d2 = d2_matrix(x)
    want = {}
    for i in range(len(x)):
        cand = sorted((d2[i, j], int(ids[j])) for j in range(len(x)) if j != i)[:3]
        for r, (d, j) in enumerate(cand, 1):
            want[(int(ids[i]), r)] = (j, round(float(np.sqrt(d)), 9))
    assert got == want


def test_exact_quantiles_and_levels(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.exponential(1.0, 500), np.full(300, 0.5)])
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, k_dist double")
    qs = [0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "k_dist", qs)
    s = np.sort(v)
    for q, g in zip(qs, got):
        pos = (len(s) - 1) * q
        lo, hi = s[int(np.floor(pos))], s[int(np.ceil(pos))]
        assert g == pytest.approx(lo + (hi - lo) * (pos - np.floor(pos)), rel=0, abs=1e-12)
    lv = density_levels(df, [0.25, 0.5, 0.9]).collect()
    eps = [r["eps"] for r in sorted(lv, key=lambda r: r["level"])]
    assert [r["level"] for r in sorted(lv, key=lambda r: r["level"])] == list(range(1, len(lv) + 1))
    assert eps == sorted(set(eps)) and eps == sorted({round(g, 6) for g in got[1:4]})
    lvl = {r["id"]: r["level"] for r in assign_level(df, density_levels(df, [0.5])).collect()}
    e = density_levels(df, [0.5]).first()["eps"]
    assert all((lvl[i] == 1) == (v[i] <= e) for i in range(len(v)))


def test_k_distance(spark):
    p, ids, x = blob(spark)
    kd = {r["id"]: r["k_dist"] for r in k_distance(p, 2).collect()}
    d2 = d2_matrix(x)
    for i in range(len(x)):
        assert kd[int(ids[i])] == pytest.approx(np.sqrt(np.sort(d2[i])[2]))


def test_eps_join_blocked_high_dim(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")
    p = points_from_array(df, "id", "e", 16)
    got = {(r["src"], r["dst"]) for r in eps_join_blocked(p, 1.2, block_rows=30).collect()}
    d2 = d2_matrix(x)
    want = {(i, j) for i in range(120) for j in range(120) if i != j and d2[i, j] <= 1.44}
    assert got == want


def test_array_points_validation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0])], "id long, e array<double>")
    v = {r["id"]: r["valid"] for r in points_from_array(df, "id", "e", 2).collect()}
    assert v == {1: True, 2: False, 3: False, 4: False}


def test_eps_join_lsh_is_subset_of_exact(spark):
    from vardens.operators.neighbours import eps_join_lsh

    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")
    p = points_from_array(df, "id", "e", 8)
    exact = {(r["src"], r["dst"]) for r in eps_join_blocked(p, 0.9, block_rows=40).collect()}
    approx = {(r["src"], r["dst"]) for r in eps_join_lsh(p, 0.9).collect()}
    assert approx <= exact and all((b, a) in approx for a, b in approx)
    assert len(approx) >= 0.5 * len(exact)


def test_write_assignments_round_trip(spark, tmp_path):
    from vardens.sources.points import write_assignments

    p, ids, x = blob(spark, n=20)
    write_assignments(p, str(tmp_path / "out"))
    write_assignments(p, str(tmp_path / "out"))  # overwrite by path
    back = {r["id"]: (r["x0"], r["x1"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {r["id"]: (r["x0"], r["x1"]) for r in p.collect()}


def test_exact_quantiles_empty_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "id long, k_dist double")
    assert exact_quantiles(df, "k_dist", [0.5]) == [None]
    with pytest.raises(ValueError):
        exact_quantiles(df, "k_dist", [1.5])
