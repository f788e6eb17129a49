"""Copies, scripts, levels, far and infinite values, hubs, chains, salting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vardens.operators.cluster import dbscan, multi_level_dbscan
from vardens.operators.components import connected_components
from vardens.operators.density import exact_quantiles
from vardens.operators.grid import build_grid
from vardens.operators.neighbours import count_within
from vardens.operators.text import cosine_join, near_copies, text_weights, tokenise


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_three_hundred_copies_are_one_group(spark):
    docs = docs_of(spark, ["eins zwei drei vier fünf"] * 300 + ["ganz anderer text hier"])
    groups = {r.id: r.group_id for r in near_copies(docs, 0.8).collect()}
    assert {groups[i] for i in range(300)} == {0} and groups[300] == 300


def test_words_of_one_document_keep_texts_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda p, i: p + letters[i // 26] + letters[i % 26]
    a = " ".join([word("x", i) for i in range(100)] + ["same", "also"])
    b = " ".join([word("y", i) for i in range(100)] + ["same", "also"])
    groups = {r.id: r.group_id for r in near_copies(docs_of(spark, [a, b]), 0.8).collect()}
    assert groups == {0: 0, 1: 1}


def test_tokens_of_other_scripts(spark):
    docs = docs_of(spark, ["基于密度 聚类 Привет żółw Œuvre", None, ""])
    assert sorted(r.term for r in tokenise(docs).collect()) == sorted(["基于密度", "聚类", "привет", "żółw", "œuvre"])
    assert [r.term for r in tokenise(docs, r"\p{IsHan}").filter("id = 0").collect()] == list("基于密度聚类")
    copies = near_copies(docs_of(spark, ["基于密度的聚类 研究", "基于密度的聚类 研究", "Привет"]), 0.9)
    assert {r.id: r.group_id for r in copies.collect()} == {0: 0, 1: 0, 2: 2}


def test_cosine_join_by_brute_force_with_hot_terms(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("abcdefghij"[k] * 2 for k in rng.integers(0, 10, rng.integers(1, 12))) for _ in range(60)]
    w = text_weights(docs_of(spark, texts))
    vec = {}
    for r in w.collect():
        vec.setdefault(r.id, {})[r.term] = r.weight
    want = {
        (a, b)
        for a in vec for b in vec
        if a != b and sum(x * vec[b].get(t, 0.0) for t, x in vec[a].items()) >= 0.5
    }
    for hot_rows in (2, 1_000_000):
        assert {(r.src, r.dst) for r in cosine_join(w, 0.5, hot_rows=hot_rows).collect()} == want


def test_far_coordinates_are_rejected(spark):
    pts = spark.createDataFrame([(1, 1e25, 0.0), (2, 5e25, 0.0), (3, 0.0, 0.0)], "id long, x0 double, x1 double")
    with pytest.raises(ValueError, match="far out"):
        dbscan(pts, 0.1, 2)


def test_too_many_flat_dimensions_and_metrics(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "id long, x0 double, x1 double, x2 double, x3 double")
    with pytest.raises(ValueError, match="array column"):
        dbscan(pts, 0.1, 2)
    flat = pts.drop("x2", "x3")
    with pytest.raises(ValueError, match="metric"):
        dbscan(flat, 0.1, 2, metric="manhattan")
    with pytest.raises(ValueError, match="euclidean"):
        dbscan(flat, 0.1, 2, metric="cosine")


def test_array_points_by_cosine(spark):
    rows = [(1, [1.0, 0.0], True), (2, [2.0, 0.0], True), (3, [5.0, 0.1], True), (4, [0.0, 1.0], True), (5, [0.0, 0.0], True), (6, None, False)]
    pts = spark.createDataFrame(rows, "id long, features array<double>, valid boolean")
    got = {r.id: (r.role, r.cluster_id) for r in dbscan(pts, 0.01, 2, metric="cosine").collect()}
    assert got == {1: ("core", 1), 2: ("core", 1), 3: ("core", 1), 4: ("noise", -1), 5: ("invalid", None), 6: ("invalid", None)}


@pytest.mark.parametrize("extra", [[float("inf")], [float("-inf"), float("nan"), None], [1e308, -1e308], [5e-324, 1e-323]])
def test_quantiles_end(spark, extra):
    values = [1.0, 2.0, 3.0, *extra]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    finite = np.array(sorted(v for v in values if v is not None and np.isfinite(v)))
    got = exact_quantiles(df, "v", [0.0, 1.0])
    assert got == [finite[0], finite[-1]]
    middle = exact_quantiles(df, "v", [0.5])[0]
    assert finite[0] <= middle <= finite[-1]


def test_all_levels_are_used(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for i in range(8):  # eight patches, each a good deal sparser than the last
        for x, y in rng.random((30, 2)) * 2.0**i:
            rows.append((n, float(x + 1000 * i), float(y)))
            n += 1
    pts = spark.createDataFrame(rows, "id long, x0 double, x1 double")
    got = multi_level_dbscan(pts, 3, [q / 8 - 0.03 for q in range(1, 9)])
    levels = {r.level for r in got.select("level").distinct().collect()} - {None}
    assert max(levels) > 5


def test_star_of_many_leaves_and_chain_over_partitions(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    got = connected_components(spark.range(0, 100_001), star.repartition(8))
    assert got.filter("cluster_id <> 0").isEmpty() and got.count() == 100_001
    chain = spark.range(0, 600).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).repartition(12)
    got = connected_components(spark.range(0, 601), chain)
    assert got.filter("cluster_id <> 0").isEmpty() and got.count() == 601


def test_hubs_are_salted_without_changing_components(spark):
    edges = [(0, i) for i in range(1, 30)] + [(29, 40), (40, 41), (50, 51), (51, 52)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(6)
    nodes = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {99}], "id long")
    got = {r.id: r.cluster_id for r in connected_components(nodes, df, hub_rows=3).collect()}
    assert got == {i: 99 if i == 99 else 50 if 50 <= i <= 52 else 0 for i in got}


def test_few_edges_end_in_one_contraction(spark):
    from vardens import session
    from vardens.operators.components import component_edges

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 900, 700), rng.integers(0, 900, 700)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "src long, dst long").repartition(16)
    start = len(session._written)
    got = {(r.a, r.b) for r in component_edges(edges).collect()}
    assert len(session._written) - start == 2  # local stars and the result: no rounds
    root = list(range(900))
    for _ in range(900):
        before = list(root)
        for x, y in zip(a, b):
            root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    assert got == {(r, n) for n, r in enumerate(root) if r != n}


def test_rounds_of_many_edges_salt_their_hubs(spark, monkeypatch):
    from vardens.operators import components

    monkeypatch.setattr(components, "LOCAL_EDGES", 1)  # on the driver: rounds go on to the end
    edges = [(0, i) for i in range(1, 30)] + [(29, 40), (40, 41), (50, 51), (51, 52)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(6)
    got = {(r.a, r.b) for r in components.component_edges(df, hub_rows=3).collect()}
    assert got == {(50, i) for i in (51, 52)} | {(0, i) for i in [*range(1, 30), 40, 41]}


def test_local_contraction_in_runs(monkeypatch):
    import pandas as pd

    from vardens.operators import components

    monkeypatch.setattr(components, "LOCAL_EDGES", 10)
    chain = [pd.DataFrame({"a": range(i, i + 4), "b": range(i + 1, i + 5)}) for i in range(0, 100, 4)]
    out = pd.concat(list(components._local_roots(iter(chain))))
    assert (out.a < out.b).all() and len(out) <= 100
    assert components._contract(out).a.eq(0).all() and len(components._contract(out)) == 100


def test_sparse_probes_do_not_repeat_a_hot_block(spark):
    rng = np.random.default_rng(2)
    dense, spread = rng.random((4000, 2)) * 0.1, rng.random((2000, 2)) * 100
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([dense, spread]))]
    pts = spark.createDataFrame(rows, "id long, x0 double, x1 double")
    g = build_grid(pts, 1.0, hot_rows=40)
    quiet = g.without_probe_salts()
    assert quiet.targets(g.pts).count() <= 2 * len(rows)
    sparse = g.pts.filter("n < 5")
    got = {r.id: r.n0 for r in count_within(quiet, sparse, [1.0]).collect()}
    xy = np.array([r[1:] for r in rows])
    for i, n in list(got.items())[:200]:
        assert n == (((xy - xy[i]) ** 2).sum(1) <= 1.0).sum()
