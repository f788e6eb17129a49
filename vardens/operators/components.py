"""E3: connected components, labelled by the smallest node id of each component.

Large-star / small-star rounds (Kiveris et al., 2014) over an undirected edge table
``(a, b)`` with ``a < b``.  A round takes, for every node, the smallest neighbour (a
``groupBy(...).min``, partially aggregated map-side) and joins it back to the node's
edges.  A giant component soon is one hub that holds its whole edge list: the edges of
nodes with more than ``hub_rows`` edges are spread over salts and the node's one row is
repeated per salt, so a hub is never one task.  Rounds go on until the edges are stars
around their smallest node (the fixpoint; every round shortens paths, so it is reached in
logarithmically many rounds), and each round is cut with a reliable checkpoint, so lineage
stays short and a lost executor only re-runs the current round.

Before the rounds, edges are contracted locally (``_local_roots``): min-label hooking with
pointer jumping over runs of at most ``LOCAL_EDGES`` edges, emitting ``(local root,
node)``.  This keeps the components, bounds a task's memory, and turns long chains that
fall inside one run into stars, so the global rounds only merge across runs.  Callers that
can should range-partition edges by locality first (``locality`` columns).  When fewer than
``LOCAL_EDGES`` edges are left, before or between rounds, they are one run: a last local
contraction ends the work without further rounds, each of which costs some ten stages of
``spark.sql.shuffle.partitions`` tasks.  The driver sees a count and one boolean per round:
whether the edges already form stars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import DEFAULT_HOT_ROWS, find_hot_keys

# Edges that one local contraction holds in memory (a few tens of MB).
LOCAL_EDGES = 1_000_000


def _normalise(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _with_smallest(d: DataFrame, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """Directed edges ``(u, v)`` joined with the smallest ``v`` of their ``u`` (``mv``), the
    edges of hubs over several tasks; and the table ``(u, mv)``."""
    m = checkpoint(d.groupBy("u").agg(F.min("v").alias("mv"), F.count(F.lit(1)).alias("n")))
    hubs = find_hot_keys(m, ["u"], "n", hub_rows)
    m = m.select("u", "mv")
    if hubs.n_hot == 0:
        return d.join(m, "u"), m
    return hubs.salt_rows(d, "v").join(hubs.expand(m), ["u", "salt"]).drop("salt"), m


def _large_star(e: DataFrame, hub_rows: int) -> DataFrame:
    joined, _ = _with_smallest(_both_ways(e), hub_rows)
    out = joined.filter(F.col("v") > F.col("u")).select(F.least("mv", "u").alias("a"), F.col("v").alias("b"))
    return _normalise(out, "a", "b")


def _small_star(e: DataFrame, hub_rows: int) -> DataFrame:
    joined, m = _with_smallest(_both_ways(e).filter(F.col("v") < F.col("u")), hub_rows)
    spokes = joined.select(F.col("mv").alias("a"), F.col("v").alias("b"))
    centre = m.select(F.col("mv").alias("a"), F.col("u").alias("b"))
    return _normalise(spokes.unionByName(centre), "a", "b")


def _is_star_forest(e: DataFrame) -> bool:
    """True when no node is both a centre and a leaf and every leaf has one centre."""
    roles = e.select(F.col("a").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")).unionByName(
        e.select(F.col("b").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    )
    bad = (
        roles.groupBy("n")
        .agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        .filter((F.col("leaf") > 1) | ((F.col("leaf") >= 1) & (F.col("centre") == 1)))
    )
    return bad.isEmpty()


def _contract(e: pd.DataFrame) -> pd.DataFrame:
    """Star edges ``(a = root, b = node)`` of the components of an edge list."""
    a = e["a"].to_numpy(np.int64)
    b = e["b"].to_numpy(np.int64)
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(nodes))  # nodes are sorted: smaller index = smaller id
    while True:
        new = lab.copy()
        np.minimum.at(new, ia, lab[ib])
        np.minimum.at(new, ib, lab[ia])
        np.minimum.at(new, lab, new.copy())  # hook the old label's node as well
        while True:  # pointer jumping
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, lab):
            break
        lab = new
    roots = nodes[lab]
    keep = roots != nodes
    return pd.DataFrame({"a": roots[keep], "b": nodes[keep]})


def _local_roots(batches):
    """Connect every node to the smallest node of its component within a run of edges.

    A run's stars stay in memory for the next batches while they are few, and are emitted
    when they outgrow half of ``LOCAL_EDGES``.
    """
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= LOCAL_EDGES:
            stars = _contract(pd.concat(held, ignore_index=True))
            held, size = [stars], len(stars)
            if size > LOCAL_EDGES // 2:
                yield stars
                held, size = [], 0
    if size:
        yield _contract(pd.concat(held, ignore_index=True))


def component_edges(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    locality: list[str] | None = None,
    hub_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Star edges ``(a = component minimum, b = other node)`` of the graph ``edges``."""
    e = edges
    if locality:
        e = e.repartitionByRange(*locality)
    e = e.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    e = checkpoint(e.mapInPandas(_local_roots, "a long, b long"))
    if e.count() < LOCAL_EDGES:
        return _one_run(e)
    e = checkpoint(_normalise(e, "a", "b"))
    while not _is_star_forest(e):
        e = checkpoint(_small_star(checkpoint(_large_star(e, hub_rows)), hub_rows))
        if e.count() < LOCAL_EDGES:
            return _one_run(e)
    return e


def _one_run(e: DataFrame) -> DataFrame:
    """The components of fewer than ``LOCAL_EDGES`` edges, whole in one local contraction."""
    return checkpoint(e.coalesce(1).mapInPandas(_local_roots, "a long, b long"))


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    id_col: str = "id",
    src: str = "src",
    dst: str = "dst",
    locality: list[str] | None = None,
    hub_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """``(id, cluster_id)``: every node of ``nodes`` with the smallest id of its component.

    Edge ends missing from ``nodes`` are ignored; isolated nodes are their own component.
    ``edges`` may be ``GridPairs`` (``nodes`` then are its points, as ``id``).
    """
    if not isinstance(edges, DataFrame):
        return edges.components(nodes.select(F.col(id_col).alias("id"))).withColumnRenamed("id", id_col)
    stars = component_edges(edges, src, dst, locality=locality, hub_rows=hub_rows)
    leaf = stars.select(F.col("b").alias(id_col), F.col("a").alias("cluster_id"))
    return nodes.select(id_col).join(leaf, id_col, "left").select(
        id_col, F.coalesce("cluster_id", id_col).alias("cluster_id")
    )
