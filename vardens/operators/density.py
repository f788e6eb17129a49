"""Density profile and multi-density parameters (D1-D4).

``exact_quantiles`` finds exact order statistics without gathering the values anywhere:
each pass splits the current value interval of every sought rank into equal-width
buckets and counts them with one distributed aggregation (at most ``buckets`` rows per
rank reach the driver); the bucket holding the rank becomes the next interval, until it
holds a single distinct value.  Interpolation follows ``quantile_cont``:
``lo + (hi - lo) * frac`` at position ``(N - 1) * q``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_eps
from ..functions.geometry import finite
from .neighbours import knn, neighbour_counts


def k_distance(points: DataFrame, k: int, knn_table: DataFrame | None = None) -> DataFrame:
    """D1: ``id, k_dist``: distance to the k-th nearest neighbour."""
    nn = knn_table if knn_table is not None else knn(points, k)
    return nn.filter(F.col("rank") == k).select("id", F.col("dist").alias("k_dist"))


def _kth_values(df: DataFrame, col: str, ranks: list[int], buckets: int = 4096) -> dict[int, float]:
    """Exact ``rank``-th smallest values (0-based) of ``col`` (non-null), by bucket narrowing."""
    v = df.select(F.col(col).cast("double").alias("v")).filter(finite("v"))
    st = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    state = {r: (st["lo"], st["hi"], 0) for r in ranks}  # interval, rows below it
    found: dict[int, float] = {}
    while len(found) < len(ranks):
        todo = [r for r in ranks if r not in found]
        for r in todo:
            lo, hi, _ = state[r]
            if lo == hi:
                found[r] = lo
        todo = [r for r in ranks if r not in found]
        if not todo:
            break
        parts = []
        for idx, r in enumerate(todo):
            lo, hi, _ = state[r]
            width = hi / buckets - lo / buckets  # hi - lo itself may overflow
            if width > 0:
                at = F.floor((F.col("v") / 2 - lo / 2) / (width / 2))
                b = F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("int")
            else:
                b = F.lit(0)
            parts.append(
                v.filter((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))).select(
                    F.lit(idx).alias("t"), b.alias("b"), "v"
                )
            )
        allp = parts[0]
        for p in parts[1:]:
            allp = allp.unionByName(p)
        hist = allp.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        rows = hist.collect()  # at most len(todo) * buckets rows
        for idx, r in enumerate(todo):
            lo, hi, below = state[r]
            mine = sorted((x for x in rows if x["t"] == idx), key=lambda x: x["b"])
            acc = below
            for x in mine:
                if r < acc + x["n"]:
                    state[r] = (x["mn"], x["mx"], acc)
                    if (x["mn"], x["mx"]) == (lo, hi):  # too narrow or too wide to divide: leave out its least value
                        least = v.agg(
                            F.sum((F.col("v") == lo).cast("long")).alias("n"), F.min(F.when(F.col("v") > lo, F.col("v"))).alias("next")
                        ).first()
                        state[r] = (lo, lo, acc) if r < acc + least["n"] else (least["next"], hi, acc + least["n"])
                    break
                acc += x["n"]
    return found


def exact_quantiles(df: DataFrame, col: str, quantiles: list[float], buckets: int = 4096) -> list[float | None]:
    """Exact continuous quantiles of the finite values of ``col`` (NULL, NaN and infinite
    ones are left out); None when there is none."""
    for q in quantiles:
        if not (0 <= q <= 1):
            raise ValueError(f"quantile {q} not in [0, 1]")
    n = df.select(F.col(col).cast("double").alias("v")).filter(finite("v")).count()
    if n == 0:
        return [None] * len(quantiles)
    pos = [(n - 1) * q for q in quantiles]
    ranks = sorted({int(math.floor(p)) for p in pos} | {int(math.ceil(p)) for p in pos})
    vals = _kth_values(df, col, ranks, buckets)
    out = []
    for p in pos:
        lo, hi = vals[int(math.floor(p))], vals[int(math.ceil(p))]
        frac = p - math.floor(p)
        out.append(lo if frac == 0 else lo + (hi - lo) * frac)
    return out


def density_levels(kdist: DataFrame, quantiles: list[float], digits: int = 6) -> DataFrame:
    """D2: ``level, eps``: exact quantiles of ``k_dist``, rounded to ``digits`` places,
    ascending, duplicates dropped, levels numbered from 1 (a handful of rows)."""
    vals = exact_quantiles(kdist, "k_dist", quantiles)
    eps = sorted({round(v, digits) for v in vals if v is not None and v > 0})
    spark = kdist.sparkSession
    return spark.createDataFrame([(i + 1, e) for i, e in enumerate(eps)], "level int, eps double")


def assign_level(kdist: DataFrame, levels: DataFrame) -> DataFrame:
    """D3: ``id, level``: the smallest level whose eps >= k_dist (NULL when none).

    ``levels`` has a handful of rows (one per quantile), so it is read to the driver
    and applied as a CASE expression: no join at all."""
    lv = sorted((r["level"], r["eps"]) for r in levels.collect())
    expr = F.lit(None).cast("int")
    for level, eps in reversed(lv):
        expr = F.when(F.col("k_dist") <= F.lit(eps), F.lit(level)).otherwise(expr)
    return kdist.select("id", expr.alias("level"))


def density_ratio(points: DataFrame, eps: float, eta: float, **kw) -> DataFrame:
    """D4: ``id, n_eps, n_eta, ratio = n_eps / n_eta`` (``eta > eps``), both exact counts
    from one descent of the box tree (``neighbour_counts``)."""
    eps, eta = check_eps(eps), check_eps(eta, "eta")
    if eta <= eps:
        raise ValueError("eta must be larger than eps")
    c = neighbour_counts(points, [eps, eta], **kw)
    return c.select(
        "id",
        F.col("n0").alias("n_eps"),
        F.col("n1").alias("n_eta"),
        (F.col("n0").cast("double") / F.col("n1").cast("double")).alias("ratio"),
    )
