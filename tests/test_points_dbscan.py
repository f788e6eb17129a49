import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reference_impl import dbscan as ref_dbscan
from vardens.operators.cluster import dbscan, density_ratio_dbscan
from vardens.sources.points import points_from_columns


def pts_df(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b double")
    return points_from_columns(df, "id", ["a", "b"])


def as_dict(df):
    return {r["id"]: (r["role"], r["cluster_id"]) for r in df.collect()}


def test_empty(spark):
    assert dbscan(pts_df(spark, []), 1.0, 2).count() == 0


def test_one_point(spark):
    assert as_dict(dbscan(pts_df(spark, [(7, 0.0, 0.0)]), 1.0, 2)) == {7: ("noise", -1)}
    assert as_dict(dbscan(pts_df(spark, [(7, 0.0, 0.0)]), 1.0, 1)) == {7: ("core", 7)}


def test_duplicates_all_core(spark):
    rows = [(i, 1.5, -2.5) for i in range(10, 30)]
    out = as_dict(dbscan(pts_df(spark, rows), 0.1, 5, hot_rows=3))
    assert set(out.values()) == {("core", 10)}


def test_exactly_eps_is_neighbour(spark):
    rows = [(1, 0.0, 0.0), (2, 0.5, 0.0)]
    out = as_dict(dbscan(pts_df(spark, rows), 0.5, 2))
    assert out == {1: ("core", 1), 2: ("core", 1)}


def test_border_nearest_core_and_tie(spark):
    # two core groups; point 50 is a border point exactly 0.5 from cores 4 and 10
    grp = [(1, 0.0, 0.0), (2, 0.125, 0.0), (3, 0.25, 0.0), (4, 0.5, 0.0)]
    grp += [(10, 1.5, 0.0), (11, 1.625, 0.0), (12, 1.75, 0.0), (13, 1.875, 0.0)]
    out = as_dict(dbscan(pts_df(spark, grp + [(50, 1.0, 0.0)]), 0.5, 4))
    assert out[50] == ("border", 1)  # tie -> smaller core id (4), cluster 1
    assert out[10] == ("core", 10)
    out = as_dict(dbscan(pts_df(spark, grp + [(50, 1.0625, 0.0)]), 0.5, 4))
    assert out[50] == ("border", 10)  # nearer to core 10


def test_invalid_rows(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, float("inf"), 0.0), (5, 0.0, 0.1)]
    out = as_dict(dbscan(pts_df(spark, rows), 0.5, 2))
    assert out[2] == ("invalid", None) and out[3] == ("invalid", None) and out[4] == ("invalid", None)
    assert out[1] == ("core", 1) and out[5] == ("core", 1)


def test_chain_of_cores(spark):
    rows = [(i, i * 0.3, -0.3 * i) for i in range(300)]
    out = as_dict(dbscan(pts_df(spark, rows), 0.5, 2))
    assert set(out.values()) == {("core", 0)}


def test_bad_parameters(spark):
    p = pts_df(spark, [(1, 0.0, 0.0)])
    for eps, mp in [(0, 3), (-1, 3), (float("nan"), 3), (1.0, 0), (1.0, 2.5)]:
        with pytest.raises(ValueError):
            dbscan(p, eps, mp)


@pytest.mark.parametrize("hot_rows", [2_000_000, 4])
def test_random_against_numpy(spark, hot_rows):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 0.3, 120), rng.normal(3, 1.0, 60), rng.uniform(-5, 5, 20)])
    b = np.concatenate([rng.normal(0, 0.3, 120), rng.normal(-2, 1.0, 60), rng.uniform(-5, 5, 20)])
    ids = rng.permutation(1000)[:200]
    rows = [(int(i), float(x), float(y)) for i, x, y in zip(ids, a, b)]
    got = as_dict(dbscan(pts_df(spark, rows), 0.35, 4, hot_rows=hot_rows))
    want = ref_dbscan(ids, np.stack([a, b], 1), 0.35, 4)
    assert got == want


def test_shift_and_partitions_do_not_change_result(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (150, 2))
    rows = [(i, float(p[0]), float(p[1])) for i, p in enumerate(x)]
    base = as_dict(dbscan(pts_df(spark, rows), 0.3, 4))
    shifted = [(i, a + 0.3 * 7, b - 0.3 * 11) for i, a, b in rows]
    assert as_dict(dbscan(pts_df(spark, shifted).repartition(5), 0.3, 4)) == base


def test_min_pts_monotone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (150, 2))
    p = pts_df(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(x)])
    c4 = {k for k, v in as_dict(dbscan(p, 0.3, 4)).items() if v[0] == "core"}
    c6 = {k for k, v in as_dict(dbscan(p, 0.3, 6)).items() if v[0] == "core"}
    assert c6 <= c4


def test_three_dimensions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (150, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    p = points_from_columns(df, "id", ["a", "b", "c"])
    got = as_dict(dbscan(p, 0.5, 4, hot_rows=5))
    assert got == ref_dbscan(np.arange(150), x, 0.5, 4)


def test_density_ratio_dbscan_against_numpy(spark):
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(0, 0.2, (100, 2)), rng.normal(2, 0.8, (80, 2))])
    ids = np.arange(180)
    p = pts_df(spark, [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x)])
    from reference_impl import d2_matrix

    d2 = d2_matrix(x)
    n_eps = (d2 <= 0.3 * 0.3).sum(1)
    n_eta = (d2 <= 0.6 * 0.6).sum(1)
    core = (n_eps / n_eta >= 0.3) & (n_eps >= 4)
    want = ref_dbscan(ids, x, 0.3, 4, core_mask=core)
    for hot in (2_000_000, 6):
        assert as_dict(density_ratio_dbscan(p, 0.3, 0.6, 0.3, 4, hot_rows=hot)) == want


def test_events_sf0001_matches_survey_numbers(spark):
    from vardens.sources.tables import event_points

    a = dbscan(event_points(spark, "/root/testdata/sf0.001"), 0.6, 5)
    r = {x["role"]: (x["n"], x["k"]) for x in a.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("k")).collect()}
    assert r["core"] == (454, 26)
    assert r["border"][0] == 169


@pytest.mark.parametrize("levels,hot_rows", [(0, 2_000_000), (3, 2_000_000), (3, 7)])
def test_box_refinement_near_eps(spark, levels, hot_rows, monkeypatch):
    import vardens.operators.grid as grid

    monkeypatch.setattr(grid, "REFINE_MIN_WORK", 0)
    # dense blobs whose gaps sit close to eps, so sub-cell boxes straddle the radius
    rng = np.random.default_rng(17)
    eps = 0.5
    centres = [(0.0, 0.0), (0.0 + eps * 1.9, 0.1), (0.3, eps * 2.05), (2.5, 2.5), (2.5 + eps * 1.02, 2.5)]
    x = np.concatenate([c + rng.uniform(-eps * 0.45, eps * 0.45, (40, 2)) for c in centres])
    ids = rng.permutation(5000)[: len(x)]
    rows = [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x)]
    got = as_dict(dbscan(pts_df(spark, rows), eps, 5, hot_rows=hot_rows, refine_levels=levels))
    assert got == ref_dbscan(ids, x, eps, 5)


@pytest.mark.parametrize("levels,min_work", [(0, 4096), (3, 4096), (3, 0), (1, 0)])
def test_refinement_diagonal_arcs(spark, levels, min_work, monkeypatch):
    import vardens.operators.grid as grid

    monkeypatch.setattr(grid, "REFINE_MIN_WORK", min_work)
    # closest cores are the arcs' middles, not any axis-extreme point: the extreme-core
    # check finds no link and sub-cell boxes straddle eps, so refinement decides it
    th = np.linspace(0, np.pi / 2, 20)
    a = np.stack([0.1 * np.cos(th), 0.1 * np.sin(th)], 1)
    b = np.stack([0.48 - 0.1 * np.cos(th), 0.48 - 0.1 * np.sin(th)], 1)
    x = np.concatenate([a, b])
    ids = np.arange(40) * 7 + 3
    rows = [(int(i), float(p), float(q)) for i, (p, q) in zip(ids, x)]
    got = as_dict(dbscan(pts_df(spark, rows), 0.5, 5, refine_levels=levels))
    assert got == ref_dbscan(ids, x, 0.5, 5)
    assert set(got.values()) == {("core", 3)}


@pytest.mark.parametrize("hot_rows", [2_000_000, 4])
def test_assign_new_hot_probe_side(spark, hot_rows):
    from reference_impl import d2_matrix
    from vardens.operators.cluster import assign_new, model_cores

    rng = np.random.default_rng(31)
    model = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(2, 0.2, (60, 2))])
    fresh = np.concatenate([np.repeat([[0.05, 0.05]], 30, 0), rng.uniform(-1, 3, (40, 2))])
    mp = pts_df(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(model)])
    nid = np.arange(len(fresh)) + 1000
    newp = pts_df(spark, [(int(i), float(a), float(b)) for i, (a, b) in zip(nid, fresh)] + [(9999, None, 1.0)])
    fit = dbscan(mp, 0.3, 5)
    got = {r["id"]: r["cluster_id"] for r in assign_new(model_cores(fit, mp), newp, 0.3, hot_rows=hot_rows).collect()}
    ref = ref_dbscan(np.arange(len(model)), model, 0.3, 5)
    cores = [i for i, v in ref.items() if v[0] == "core"]
    want = {9999: None}
    for k, p in zip(nid, fresh):
        c = sorted((float(((p - model[i]) ** 2).sum()), i) for i in cores)
        c = [t for t in c if t[0] <= 0.09]
        want[int(k)] = ref[c[0][1]][1] if c else -1
    assert got == want


def test_multi_level_against_numpy(spark):
    from reference_impl import d2_matrix
    from vardens.operators.cluster import multi_level_dbscan

    rng = np.random.default_rng(41)
    x = np.concatenate([rng.normal(0, 0.05, (60, 2)), rng.normal(2, 0.4, (60, 2)), rng.uniform(-2, 4, (15, 2))])
    ids = np.arange(len(x)) * 2 + 1
    got = {r["id"]: (r["role"], r["cluster_id"], r["level"]) for r in
           multi_level_dbscan(pts_df(spark, [(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x)]), 3, [0.3, 0.8]).collect()}
    d2 = d2_matrix(x)
    kd = np.sqrt(np.sort(d2, 1)[:, 3])
    s = np.sort(kd)
    levels = []
    for q in [0.3, 0.8]:
        pos = (len(s) - 1) * q
        lo, hi = s[int(np.floor(pos))], s[int(np.ceil(pos))]
        levels.append(round(lo + (hi - lo) * (pos - np.floor(pos)), 6))
    levels = sorted(set(levels))
    want, rest = {}, np.arange(len(x))
    for lv, e in enumerate(levels, 1):
        r = ref_dbscan(ids[rest], x[rest], e, 4)
        for k, (role, cid) in r.items():
            if role != "noise":
                want[k] = (role, cid, lv)
        rest = np.array([i for i in rest if int(ids[i]) not in want])
    for i in rest:
        want[int(ids[i])] = ("noise", -1, None)
    assert got == want


def test_validate_rejects_duplicate_ids(spark):
    p = pts_df(spark, [(1, 0.0, 0.0), (1, 1.0, 1.0), (2, 0.5, 0.5)])
    with pytest.raises(ValueError):
        dbscan(p, 0.5, 2, validate=True)
    assert dbscan(pts_df(spark, [(1, 0.0, 0.0), (2, 0.1, 0.0)]), 0.5, 2, validate=True).count() == 2


def test_written_assignments_of_the_events_are_read_again(spark):
    from tests.compare import compare
    from vardens.plans.registry import REGISTRY

    sf = "/root/testdata/sf0.001"
    assert REGISTRY["write_assignments_events"].run(spark, sf).columns == ["id", "role", "cluster_id"]
    assert compare(spark, "write_assignments_events", sf, verbose=False)
