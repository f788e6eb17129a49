"""Pairs kept on their grid give what the listed pair table gives, without listing it."""

import numpy as np

from vardens import session
from vardens.operators.cluster import attach_border, core_edges, core_points, dbscan_from_pairs, neighbour_count
from vardens.operators.components import connected_components
from vardens.operators.neighbours import eps_join_grid


def _points(spark, xy, ids=None):
    ids = range(len(xy)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, xy)], "id long, x0 double, x1 double")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_textbook_steps_equal_those_on_the_listed_pairs(spark):
    rng = np.random.default_rng(3)
    p = _points(spark, np.concatenate([rng.normal(0, 0.4, (120, 2)), rng.uniform(-3, 3, (120, 2))]))
    listed, kept = eps_join_grid(p, 0.25), eps_join_grid(p, 0.25, factored=True)
    assert _rows(neighbour_count(p, kept)) == _rows(neighbour_count(p, listed))
    cores = core_points(neighbour_count(p, kept, enough=5), 5)
    assert _rows(cores) == _rows(core_points(neighbour_count(p, listed), 5))
    edges = core_edges(listed, cores)
    assert _rows(core_edges(kept, cores).select("src", "dst")) == _rows(edges.select("src", "dst"))
    comps = connected_components(cores, edges)
    assert _rows(connected_components(cores, core_edges(kept, cores))) == _rows(comps)
    assert _rows(attach_border(kept, cores, comps)) == _rows(attach_border(listed, cores, comps))


def test_a_crowd_writes_no_pairs(spark):
    p = _points(spark, np.random.default_rng(4).uniform(0, 0.1, (1500, 2)))
    before = len(session._written)
    out = dbscan_from_pairs(p, eps_join_grid(p, 0.2, factored=True), 5)
    assert {tuple(r)[1:] for r in out.collect()} == {("core", 0)}
    assert sum(spark.read.parquet(t).count() for t in session._written[before:]) < 20_000  # 2,248,500 pairs


def test_repeated_ids_keep_the_listed_table(spark):
    p = _points(spark, [(0, 0), (0, 0), (0.1, 0)], [1, 1, 2])
    assert _rows(neighbour_count(p, eps_join_grid(p, 0.2, factored=True))) == _rows(neighbour_count(p, eps_join_grid(p, 0.2)))
