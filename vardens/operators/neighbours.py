"""Neighbourhood search: range joins, exact counts, k nearest neighbours (C1-C3, C5, C6).

All 2-3-d operators express the range join as an *equi-join on grid cells* plus an exact
squared-distance filter (a plain distance predicate would plan a nested-loop join).
Point tables are partitioned by ``(cell, salt)`` so a hot cell is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_eps
from ..functions.geometry import (
    CELL_SLACK,
    box_max_sqdist,
    box_min_sqdist,
    coord_names,
    offsets,
)
from ..session import checkpoint
from .block_pairs import TILE_ROWS, BlockPairs, listed, meet, travel_rows
from .box_pairs import counts_within
from .box_tree import LEAF, nearest
from .grid import build_grid, point_cols, with_valid
from .grid_pairs import GridPairs
from .skew import DEFAULT_HOT_ROWS, DEFAULT_MAX_BROADCAST_ROWS


def eps_join_grid(
    points: DataFrame,
    eps: float,
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    factored: bool = False,
) -> DataFrame | GridPairs:
    """C1: ``src, dst, d2, dist`` for all pairs within ``eps`` (inclusive), both
    directions, self excluded.  Exact, 2-3-d.

    Cells of side eps: a pair is at most one cell apart.  Only the forward half of the
    neighbourhood is joined (same cell with ``src < dst`` plus the lexicographically
    positive offsets) and every pair found is written both ways.  The output is the pair set
    itself, so its size grows with the square of local density.  ``factored``: the same pairs
    as ``grid_pairs.GridPairs``, from which the textbook steps work without listing them.
    """
    eps = check_eps(eps)
    if factored:
        return factored_pairs(points, eps, hot_rows, max_broadcast_rows)
    g = build_grid(points, eps, side=eps * (1 + CELL_SLACK), hot_rows=hot_rows, max_broadcast_rows=max_broadcast_rows)
    d = g.d
    fwd = [tuple([0] * d)] + offsets(d, 1, forward_only=True)
    probes = g.probe(g.pts, offs=fwd)
    same = F.lit(True)
    for c, t in zip(g.cells, g.tcells):
        same = same & (F.col(f"p{c}") == F.col(t))
    pairs = (
        probes.join(g.targets(g.pts), on=g.keys)
        .filter(~same | (F.col("pid") < F.col("qid")))
        .select("pid", "qid", g.pair_d2().alias("d2"))
        .filter(F.col("d2") <= F.lit(g.r2))
    )
    ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("pid", "qid"), ("qid", "pid"))]
    both = pairs.select(F.explode(F.array(*ways)).alias("w"), "d2").select("w.src", "w.dst", "d2")
    return both.withColumn("dist", F.sqrt("d2"))


def factored_pairs(points: DataFrame, eps: float, hot_rows: int, max_broadcast_rows: int) -> DataFrame | GridPairs:
    """The pairs as ``GridPairs``; where ids repeat or are null, whose rows are then several
    ends of one id, the listed table."""
    pts = with_valid(points, point_cols(points))
    ids = pts.filter(F.col("valid")).groupBy("id").count()
    if not ids.filter((F.col("count") > 1) | F.col("id").isNull()).isEmpty():
        return checkpoint(eps_join_grid(points, eps, hot_rows, max_broadcast_rows))
    return GridPairs(pts, eps, hot_rows, max_broadcast_rows)


def neighbour_counts(
    points: DataFrame,
    radii: list[float],
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """Exact neighbourhood sizes ``id, n0, n1, ...`` (self included) of every valid point
    for each radius in ``radii``, 1-3-d.

    Two trees of boxes are descended together (``box_pairs``) down to blocks of ``leaf``
    locations: boxes wholly within a radius are added by count, for all points of the asking
    box at once, and points are compared only with runs of blocks that their circle crosses.
    """
    radii = [check_eps(r, "radius") for r in radii]
    cols = point_cols(points)
    v = with_valid(points, cols).filter(F.col("valid")).select("id", *cols)
    found = counts_within(v, cols, radii, hot_rows, max_broadcast_rows, leaf)
    if found is None:
        return v.select("id", *[F.lit(0).cast("long").alias(f"n{i}") for i in range(len(radii))])
    return found


# Target cells with at most this many points are compared point by point; larger ones
# are first summarised per sub-cell.
SMALL_CELL_ROWS = 32


def count_within(
    g, probe_pts: DataFrame, radii: list[float], subdivisions: int | None = None, small_cell_rows: int = SMALL_CELL_ROWS
) -> DataFrame:
    """``id, n0, ...``: exact counts of ``g.pts`` within each radius (<= the grid's) of
    every row of ``probe_pts`` (``id, x.., c.., salt``), where these are points of sparse
    cells (E6): a cell meets few probes, however full it is.

    A cell of at most ``small_cell_rows`` points is compared point by point.  A larger one is
    summarised per sub-cell (count and bounding box): whole sub-cells are added by count, and
    only those that straddle the radius are compared point by point.  Both sides are salted
    by hot cell."""
    m = subdivisions or (4 if g.d <= 2 else 2)
    subs = [f"s{i}" for i in range(g.d)]
    bsubs = [f"b{x}" for x in subs]
    sub_exprs = [
        F.least(F.greatest(F.floor((F.col(x) / F.lit(g.side) - F.col(c)) * F.lit(m)), F.lit(0)), F.lit(m - 1))
        .cast("int")
        .alias(s)
        for x, c, s in zip(g.cols, g.cells, subs)
    ]
    pts = g.pts.select("id", *g.cols, *g.cells, "salt", "n", *sub_exprs)
    small = pts.filter(F.col("n") <= F.lit(small_cell_rows))
    large = pts.filter(F.col("n") > F.lit(small_cell_rows))
    probes = g.probe(probe_pts.select("id", *g.cols, *g.cells, "salt"))
    nr = len(radii)

    def within(d2, i):
        return F.when(d2 <= F.lit(radii[i] * radii[i]), F.lit(1)).otherwise(F.lit(0))

    # (1) point by point against small cells
    pa = probes.join(g.targets(small), on=g.keys).select("pid", g.pair_d2().alias("d2"))
    part_a = pa.select("pid", *[within(F.col("d2"), i).alias(f"n{i}") for i in range(nr)])

    # (2) whole sub-cells of large cells
    lo = [f"lo{i}" for i in range(g.d)]
    hi = [f"hi{i}" for i in range(g.d)]
    summ = large.groupBy(*g.cells, *subs).agg(
        F.count(F.lit(1)).alias("k"),
        *[F.min(x).alias(l) for x, l in zip(g.cols, lo)],
        *[F.max(x).alias(h) for x, h in zip(g.cols, hi)],
    )
    sm = summ.select(
        F.col("c0").alias("id"),  # placeholder id for targets(); dropped below
        *[F.lit(0.0).alias(x) for x in g.cols],
        *g.cells,
        F.lit(0).alias("salt"),
        *[F.col(s).alias(b) for s, b in zip(subs, bsubs)],
        "k",
        *lo,
        *hi,
    )
    sm = g.targets(sm, extra=(*bsubs, "k", *lo, *hi)).drop("qid", *[f"q{x}" for x in g.cols], "salt")
    pb = probes.filter(F.col("salt") == 0).drop("salt").join(sm, on=g.tcells + ["psalt"])
    plo = [f"p{x}" for x in g.cols]
    near = box_min_sqdist(plo, plo, lo, hi)
    far = box_max_sqdist(plo, plo, lo, hi)
    flags = []
    for i, r in enumerate(radii):
        flags += [(far <= F.lit(r * r)).alias(f"all{i}"), (near <= F.lit(r * r)).alias(f"some{i}")]
    pb = pb.select("pid", *plo, "psalt", *g.tcells, *bsubs, "k", *flags)
    anyr = F.col("some0")
    for i in range(1, nr):
        anyr = anyr | F.col(f"some{i}")
    pb = checkpoint(pb.filter(anyr))
    part_b = pb.select(
        "pid", *[F.when(F.col(f"all{i}"), F.col("k")).otherwise(F.lit(0)).alias(f"n{i}") for i in range(nr)]
    )

    # (3) point by point inside straddling sub-cells of large cells
    unsure = F.lit(False)
    for i in range(nr):
        unsure = unsure | (F.col(f"some{i}") & ~F.col(f"all{i}"))
    op = g.hot.expand(pb.filter(unsure), key_cols=g.tcells)
    tl = g.targets(large.select("*", *[F.col(s).alias(b) for s, b in zip(subs, bsubs)]), extra=tuple(bsubs))
    pc = op.join(tl, on=g.keys + bsubs).withColumn("d2", g.pair_d2())
    part_c = pc.select(
        "pid",
        *[
            F.when(F.col(f"some{i}") & ~F.col(f"all{i}"), within(F.col("d2"), i)).otherwise(F.lit(0)).alias(f"n{i}")
            for i in range(nr)
        ],
    )

    allp = part_a.unionByName(part_b).unionByName(part_c)
    return allp.groupBy(F.col("pid").alias("id")).agg(*[F.sum(f"n{i}").cast("long").alias(f"n{i}") for i in range(nr)])


def knn(
    points: DataFrame,
    k: int,
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """C5: ``id, rank, nbr, dist``: the exact ``k`` nearest neighbours of every valid point
    (self excluded, ties by neighbour id), 2-3-d.

    Blocks of locations under a tree of boxes (``box_tree``): a block's own points bound its
    search, and the blocks within the bound meet in a task.  Places that many points share are
    one location.  The result is lazy: write it where it is read more than once.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer >= 1")
    cols = point_cols(points)
    v = with_valid(points, cols).filter(F.col("valid")).select("id", *cols)
    found = nearest(v, cols, k, hot_rows, max_broadcast_rows)
    if found is None:
        return v.select("id", F.lit(1).alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("dist")).limit(0)
    return found.select("id", "rank", "nbr", F.sqrt("d2").alias("dist"))


# ------------------------------------------------------------------- high dimension


def eps_join_blocked(points: DataFrame, eps: float, block_rows: int = 4096) -> DataFrame:
    """C2: exact range join for high-dimensional array points (``id, features, valid``):
    ``src, dst, d2, dist``, both directions, self excluded.

    Near-isotropic high-dimensional data admits no exact pruning, so this compares all
    pairs: points are hashed into blocks, and every pair of blocks is one group, screened
    with products of at most ``block_rows`` rows a side and re-checked exactly in float64 (see
    ``block_pairs``).  Work is quadratic in the number of points by nature; use
    ``eps_join_lsh`` (C3) for large inputs.
    """
    return BlockPairs(points, check_eps(eps), block_rows).table()


def eps_join_lsh(
    points: DataFrame, eps: float, tables: int = 8, width: float | None = None, seed: int = 7
) -> DataFrame:
    """C3: approximate range join for large high-dimensional inputs by the hashes of Spark
    ML's ``BucketedRandomProjectionLSH``: ``src, dst, d2, dist``, both directions, self
    excluded: the pairs that share a bucket of at least one of ``tables``.  May miss pairs
    (recall < 1), never reports a pair beyond eps: the distance is exact, in float64.

    Points are cut into blocks in the order of their hashes; blocks without a common bucket
    never meet, the others are multiplied (``block_pairs``), so a pair is compared once,
    however many buckets it shares."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    eps = check_eps(eps)
    v = points.filter(F.col("valid")).select("id", "features").distinct()
    v = v.withColumn("vec", array_to_vector("features"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="vec", outputCol="h", bucketLength=width or eps * 2.0, numHashTables=tables, seed=seed
    )
    hashes = [f"h{i}" for i in range(tables)]
    hashed = lsh.fit(v).transform(v).select("id", "features", *[vector_to_array(F.col("h")[i])[0].cast("long").alias(h) for i, h in enumerate(hashes)])
    n = v.count()
    nb = max(1, math.ceil(n / travel_rows(n, TILE_ROWS)))
    blk = checkpoint(hashed.repartitionByRange(nb, *hashes, "id").withColumn("blk", F.spark_partition_id()))
    held = blk.select("blk", F.posexplode(F.array(*hashes)).alias("t", "h")).distinct()
    held = held.withColumnRenamed("blk", "bi").join(held.withColumnRenamed("blk", "bj"), ["t", "h"])
    met = checkpoint(held.filter(F.col("bi") <= F.col("bj")).select("bi", "bj").distinct())
    found = meet(blk, met, listed, "src long, dst long, d2 double", eps, TILE_ROWS)
    return found.withColumn("dist", F.sqrt("d2"))


__all__ = ["eps_join_grid", "neighbour_counts", "knn", "eps_join_blocked", "eps_join_lsh", "coord_names"]
