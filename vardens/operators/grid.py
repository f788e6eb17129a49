"""Grid machinery shared by the clustering operators (2-3-d points).

Cells have side ``eps / sqrt(d)`` (slightly less), so the points of one cell are all
within eps of each other ("cell contraction", grid DBSCAN after Gan & Tao):

* a cell holding at least ``min_pts`` points is all core, with no pair enumerated;
* all cores of one cell belong to one cluster, so components are computed over cells;
* only points of *sparse* cells (fewer than ``min_pts`` points) are counted, and a dense
  neighbour cell meets at most ``(2k+1)^d * min_pts`` such probes; large neighbour cells
  are counted through sub-cell boxes (``neighbours.count_within``), so the counting work
  is linear in the data whatever the density.

Two core cells are linked when some pair of their cores is within eps.  The 2d extreme
cores of each cell (min and max per axis) are compared first, which settles most pairs
of adjacent dense cells; the rest is decided on bounding boxes of sub-cells (``m^d`` per
cell): a sub-cell pair whose *largest* box
distance is within eps is a certain link, one whose *smallest* box distance exceeds eps
is no link, and only the remaining sub-cell pairs of cell pairs without a certain link
are checked point by point.

Point tables are partitioned by ``(cell, salt)`` (see ``skew``), so a hot cell is spread
over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_eps
from ..functions.geometry import (
    box_max_sqdist,
    box_min_sqdist,
    cell_exprs,
    cell_names,
    contraction_side,
    offsets,
    reach,
    sqdist,
    with_neighbour_cells,
)
from ..session import checkpoint
from .components import connected_components
from .skew import DEFAULT_HOT_ROWS, DEFAULT_MAX_BROADCAST_ROWS, HotKeys, find_hot_keys


def point_cols(points: DataFrame) -> list[str]:
    cols = sorted((c for c in points.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if not cols:
        raise ValueError("points need flat coordinate columns x0, x1, ...")
    return cols


def with_valid(points: DataFrame, cols: list[str]) -> DataFrame:
    if "valid" in points.columns:
        return points
    from ..functions.geometry import finite

    ok = None
    for c in cols:
        ok = finite(c) if ok is None else ok & finite(c)
    return points.withColumn("valid", F.coalesce(ok, F.lit(False)))


@dataclass
class Grid:
    cols: list[str]
    cells: list[str]
    side: float
    radius: float
    r2: float
    k: int
    hot: HotKeys  # hot cells of the target rows (``pts``)
    pts: DataFrame  # valid points: id, x.., c.., salt, n (points in the cell)
    phot: HotKeys | None = None  # hot cells of the probing rows, when they differ
    _nb: DataFrame | None = field(default=None, repr=False)

    @property
    def d(self) -> int:
        return len(self.cols)

    @property
    def tcells(self) -> list[str]:
        return [f"t{i}" for i in range(self.d)]

    @property
    def keys(self) -> list[str]:
        """Join keys of a probe join: target cell, target salt, probe salt."""
        return self.tcells + ["salt", "psalt"]

    @property
    def probe_hot(self) -> HotKeys:
        return self.phot or self.hot

    def without_probe_salts(self) -> "Grid":
        """The same grid for probes that stand in no hot cell: targets are not repeated."""
        return replace(self, phot=HotKeys(self.hot.keys, self.hot.table, 0, self.hot.max_broadcast_rows), _nb=None)

    def neighbour_offsets(self, forward_only: bool = False):
        return offsets(self.d, self.k, forward_only)

    def _probe_salts(self) -> DataFrame:
        """``t.., pmax``: the largest probe-side salt count among the cells around t
        (at most (2k+1)^d rows per hot cell; broadcast after a size check)."""
        if self._nb is None:
            ph = self.probe_hot
            ex = with_neighbour_cells(ph.table, self.cells, self.tcells, self.neighbour_offsets())
            nb = ex.groupBy(*self.tcells).agg(F.max("nsalt").alias("pmax"))
            size = (2 * self.k + 1) ** self.d * ph.n_hot
            self._nb = F.broadcast(nb) if size <= ph.max_broadcast_rows else nb
        return self._nb

    def probe(self, df: DataFrame, prefix: str = "p", offs=None, salted: bool = True) -> DataFrame:
        """Rows of ``df`` (``id, x.., c..[, salt]``) renamed with ``prefix``, keeping their
        own salt as ``psalt``, exploded to the neighbour cells ``t..`` and (when
        ``salted``) to the salts of those cells."""
        if "salt" not in df.columns or self.phot is not None:
            df = self.probe_hot.salt_rows(df.drop("salt") if "salt" in df.columns else df, "id")
        ren = df.select(
            F.col("id").alias(f"{prefix}id"),
            *[F.col(x).alias(f"{prefix}{x}") for x in self.cols],
            *[F.col(c).alias(f"{prefix}{c}") for c in self.cells],
            F.col("salt").alias("psalt"),
        )
        offs = offs if offs is not None else self.neighbour_offsets()
        ex = with_neighbour_cells(ren, [f"{prefix}{c}" for c in self.cells], self.tcells, offs)
        return self.hot.expand(ex, key_cols=self.tcells) if salted else ex

    def targets(self, df: DataFrame, prefix: str = "q", extra: tuple[str, ...] = ()) -> DataFrame:
        """Rows of ``df`` (``id, x.., c.., salt``) keyed by ``t.., salt, psalt``: each row
        is repeated once per probe-side salt of the hot cells around it."""
        out = df.select(
            F.col("id").alias(f"{prefix}id"),
            *[F.col(x).alias(f"{prefix}{x}") for x in self.cols],
            *[F.col(c).alias(t) for c, t in zip(self.cells, self.tcells)],
            "salt",
            *extra,
        )
        return self.expand_probe_salts(out)

    def expand_probe_salts(self, df: DataFrame) -> DataFrame:
        """Repeat rows keyed by ``t..`` once per probe-side salt around that cell."""
        if self.probe_hot.n_hot == 0:
            return df.withColumn("psalt", F.lit(0))
        out = df.join(self._probe_salts(), on=self.tcells, how="left")
        n = F.coalesce(F.col("pmax"), F.lit(1))
        return out.withColumn("psalt", F.explode(F.sequence(F.lit(0), n - F.lit(1)))).drop("pmax")

    def pair_d2(self, p: str = "p", q: str = "q"):
        return sqdist([f"{p}{x}" for x in self.cols], [f"{q}{x}" for x in self.cols])


# Cells from the origin up to which ``floor(x / side)`` keeps the slack of a cell side
# under rounding; farther out a cell could not be trusted to hold neighbours only.
MAX_CELLS = 1 << 22


def check_extent(valid: DataFrame, cols: list[str], side: float) -> None:
    """One aggregate over the points, before any join: no coordinate is too far out."""
    far = valid.agg(F.max(F.greatest(*[F.abs(c) for c in cols]) if len(cols) > 1 else F.abs(cols[0]))).first()[0]
    if far is not None and far / side > MAX_CELLS:
        raise ValueError(f"coordinates up to {far:g} are too far out for radius cells of side {side:g}; shift or scale them")


def build_grid(
    points: DataFrame,
    radius: float,
    side: float | None = None,
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    check: bool = True,
) -> Grid:
    """Grid the valid points; cells of ``side`` (default: contraction side of ``radius``)."""
    radius = check_eps(radius)
    cols = point_cols(points)
    d = len(cols)
    side = side or contraction_side(radius, d)
    cells = cell_names(d)
    if d > 3:
        raise ValueError("a grid takes 1 to 3 coordinate columns; pass more dimensions as an array column")
    pts = with_valid(points, cols)
    if check:
        check_extent(pts.filter(F.col("valid")), cols, side)
    v = pts.filter(F.col("valid")).select("id", *cols, *cell_exprs(cols, side, cells))
    counts = v.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
    hot = find_hot_keys(counts, cells, "n", hot_rows, max_broadcast_rows)
    salted = hot.salt_rows(v, "id")
    withn = salted.join(hot.expand(counts), on=cells + ["salt"])
    return Grid(cols, cells, side, radius, radius * radius, reach(side, radius), hot, withn)


def contracted_roles(g: Grid, min_pts: int) -> DataFrame:
    """``id, x.., c.., salt, core, n_eps``: DBSCAN core flags with cell contraction.

    ``n_eps`` is exact for points of sparse cells and NULL for points of dense cells
    (they are core without counting).
    """
    p = g.pts
    dense = p.filter(F.col("n") >= min_pts).select(
        "id", *g.cols, *g.cells, "salt", F.lit(True).alias("core"), F.lit(None).cast("long").alias("n_eps")
    )
    from .neighbours import count_within

    sparse = p.filter(F.col("n") < min_pts)
    counted = count_within(g.without_probe_salts(), sparse, [g.radius]).select("id", F.col("n0").alias("n_eps"))
    sparse_roles = sparse.join(counted, "id").select(
        "id", *g.cols, *g.cells, "salt", (F.col("n_eps") >= min_pts).alias("core"), "n_eps"
    )
    return dense.unionByName(sparse_roles)


def _subdivisions(d: int) -> int:
    return 4 if d <= 2 else 2


def _sub_exprs(g: Grid, m: int, level: int, names=None):
    """Sub-cell index per axis at resolution ``m * 2^level`` within the cell."""
    res = m * (2**level)
    out = []
    for i, (x, c) in enumerate(zip(g.cols, g.cells)):
        e = F.least(F.greatest(F.floor((F.col(x) / F.lit(g.side) - F.col(c)) * F.lit(res)), F.lit(0)), F.lit(res - 1))
        e = e.cast("int")
        out.append(e.alias(names[i]) if names else e)
    return out


def nearest_core(g: Grid, probes: DataFrame, cores_l: DataFrame, m: int | None = None) -> DataFrame:
    """``pid, b``: for each probe row (``id, x.., c..[, salt]``) the nearest core of
    ``cores_l`` (``id, x.., c.., salt, cluster_id``) within the radius, as
    ``b = struct(d2, qid, cluster_id)`` (ties: smaller core id), or NULL.

    Box pruning: cores are summarised per sub-cell.  For a probe, U = the smallest
    farthest-corner distance over the boxes (a core within sqrt(U) surely exists), so
    only boxes whose nearest corner is within min(U, r^2) can hold the nearest core,
    and only their points are compared.  Both sides are salted by hot cell."""
    m = m or _subdivisions(g.d)
    subs = [f"s{i}" for i in range(g.d)]
    bsubs = [f"b{x}" for x in subs]
    lo = [f"lo{i}" for i in range(g.d)]
    hi = [f"hi{i}" for i in range(g.d)]
    cs = cores_l.select("*", *_sub_exprs(g, m, 0, subs))
    boxes = cs.groupBy(*g.cells, *subs).agg(
        *[F.min(x).alias(l) for x, l in zip(g.cols, lo)], *[F.max(x).alias(h) for x, h in zip(g.cols, hi)]
    )
    boxes = g.expand_probe_salts(
        boxes.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], *[F.col(x).alias(b) for x, b in zip(subs, bsubs)], *lo, *hi)
    )
    pr = g.probe(probes, salted=False)
    plo = [f"p{x}" for x in g.cols]
    pb = pr.join(boxes, on=g.tcells + ["psalt"]).select(
        "pid", *plo, "psalt", *g.tcells, *bsubs,
        box_min_sqdist(plo, plo, lo, hi).alias("near"), box_max_sqdist(plo, plo, lo, hi).alias("far"),
    ).filter(F.col("near") <= F.lit(g.r2))
    bound = F.least(F.min("far").over(Window.partitionBy("pid")), F.lit(g.r2))
    keep = pb.withColumn("u", bound).filter(F.col("near") <= F.col("u")).drop("near", "far", "u")
    keep = g.hot.expand(keep, key_cols=g.tcells)
    tg = g.targets(cs, extra=(*[F.col(x).alias(b) for x, b in zip(subs, bsubs)], "cluster_id"))
    hits = keep.join(tg, on=g.keys + bsubs).withColumn("d2", g.pair_d2()).filter(F.col("d2") <= F.lit(g.r2))
    best = hits.groupBy("pid").agg(F.min(F.struct("d2", "qid", "cluster_id")).alias("b"))
    ids = probes.select(F.col("id").alias("pid"))
    return ids.join(best, "pid", "left")


# Levels of box refinement for straddling sub-cell pairs before comparing points, and
# the point-pair count above which an undecided sub-cell pair is refined at all.
REFINE_LEVELS = 3
REFINE_MIN_WORK = 4096


def cluster_roles(
    g: Grid, roles: DataFrame, refine_levels: int = REFINE_LEVELS, sparse_noncores: bool = False
) -> DataFrame:
    """Clusters from core flags: ``id, role, cluster_id`` for the valid points.

    ``roles`` has ``id, x.., c.., salt, core``.  cluster_id = smallest core id of the
    component; a border point takes the cluster of its nearest core (ties: smaller core
    id); a point with no core within eps is noise (-1).  ``sparse_noncores``: no point
    that is not core stands in a hot cell (so in DBSCAN, whose hot cells are all core).
    """
    roles = checkpoint(roles.select("id", *g.cols, *g.cells, "salt", "core"))
    cores_l = labelled_cores(g, roles.filter(F.col("core")), refine_levels)
    core_out = cores_l.select("id", F.lit("core").alias("role"), F.col("cluster_id").cast("long"))
    noncore = roles.filter(~F.col("core"))
    best = nearest_core(g.without_probe_salts() if sparse_noncores else g, noncore, cores_l)
    other_out = best.select(
        F.col("pid").alias("id"),
        F.when(F.col("b").isNull(), F.lit("noise")).otherwise(F.lit("border")).alias("role"),
        F.coalesce(F.col("b.cluster_id"), F.lit(-1)).cast("long").alias("cluster_id"),
    )
    return core_out.unionByName(other_out)


def labelled_cores(g: Grid, cores: DataFrame, refine_levels: int = REFINE_LEVELS) -> DataFrame:
    """``cores`` (``id, x.., c.., salt``, a written table) with the ``cluster_id`` of their
    component under links within the radius: its smallest id."""
    m = _subdivisions(g.d)
    subs = [f"s{i}" for i in range(g.d)]
    sub_exprs = [
        F.least(F.greatest(F.floor((F.col(x) / F.lit(g.side) - F.col(c)) * F.lit(m)), F.lit(0)), F.lit(m - 1))
        .cast("int")
        .alias(s)
        for x, c, s in zip(g.cols, g.cells, subs)
    ]
    cores_s = cores.select("*", *sub_exprs)
    lo = [f"lo{i}" for i in range(g.d)]
    hi = [f"hi{i}" for i in range(g.d)]
    summ = checkpoint(
        cores_s.groupBy(*g.cells, *subs).agg(
            F.min("id").alias("mid"),
            F.count(F.lit(1)).alias("k"),
            *[F.min(x).alias(l) for x, l in zip(g.cols, lo)],
            *[F.max(x).alias(h) for x, h in zip(g.cols, hi)],
        )
    )
    corecells = summ.groupBy(*g.cells).agg(F.min("mid").alias("node"))

    # candidate cell pairs: each unordered neighbouring pair once
    cand = with_neighbour_cells(corecells, g.cells, g.tcells, g.neighbour_offsets(forward_only=True))
    cand = cand.select(*g.cells, *g.tcells, F.col("node").alias("node1")).join(
        corecells.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], F.col("node").alias("node2")),
        on=g.tcells,
    )
    # cheap certain links first: the 2d extreme cores of each cell (min and max per axis)
    ext = []
    for x in g.cols:
        ext += [F.min(F.struct(F.col(x).alias("k"), *g.cols)).alias(f"mn{x}"), F.max(F.struct(F.col(x).alias("k"), *g.cols)).alias(f"mx{x}")]
    reps = cores.groupBy(*g.cells).agg(*ext)
    reps = reps.select(*g.cells, F.explode(F.array(*[F.col(c) for c in reps.columns if c not in g.cells])).alias("r"))
    reps = reps.select(*g.cells, *[F.col(f"r.{x}").alias(x) for x in g.cols])
    ra = reps.select(*g.cells, *[F.col(x).alias(f"p{x}") for x in g.cols])
    rb = reps.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], *[F.col(x).alias(f"q{x}") for x in g.cols])
    rep_links = (
        cand.join(ra, on=g.cells)
        .join(rb, on=g.tcells)
        .filter(g.pair_d2() <= F.lit(g.r2))
        .select("node1", "node2", *g.cells)
        .distinct()
    )
    rep_links = checkpoint(rep_links)
    cand = cand.join(rep_links.select("node1", "node2"), on=["node1", "node2"], how="left_anti")

    asubs, bsubs = [f"a{x}" for x in subs], [f"b{x}" for x in subs]
    alo, ahi = [f"a{x}" for x in lo], [f"a{x}" for x in hi]
    blo, bhi = [f"b{x}" for x in lo], [f"b{x}" for x in hi]
    keep_cols = ["node1", "node2", *g.cells, *g.tcells, *asubs, *bsubs, "ka", "kb"]

    def classify(df):
        return df.select(
            *keep_cols,
            (box_max_sqdist(alo, ahi, blo, bhi) <= F.lit(g.r2)).alias("certain"),
            (box_min_sqdist(alo, ahi, blo, bhi) <= F.lit(g.r2)).alias("maybe"),
        ).filter(F.col("maybe"))

    a = summ.select(*g.cells, *[F.col(x).alias(y) for x, y in zip(subs, asubs)], F.col("k").alias("ka"),
                    *[F.col(x).alias(f"a{x}") for x in lo + hi])
    b = summ.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], *[F.col(x).alias(y) for x, y in zip(subs, bsubs)],
                    F.col("k").alias("kb"), *[F.col(x).alias(f"b{x}") for x in lo + hi])
    sp = checkpoint(classify(cand.join(a, on=g.cells).join(b, on=g.tcells)))

    def settle(pairs):
        """-> (certain links, undecided sub-cell pairs of cell pairs without one)."""
        linked = pairs.groupBy("node1", "node2", *g.cells).agg(F.max(F.col("certain").cast("int")).alias("certain"))
        sure = linked.filter(F.col("certain") == 1).select("node1", "node2", *g.cells)
        rest = pairs.join(linked.filter(F.col("certain") == 0).select("node1", "node2"), on=["node1", "node2"])
        return sure, rest.select(*keep_cols)

    def point_links(pairs, level):
        """Compare the cores of undecided sub-cell pairs (sub-cells at ``level``)."""
        cf = cores.select("*", *_sub_exprs(g, m, level, subs))
        ca = cf.select(*g.cells, *[F.col(x).alias(y) for x, y in zip(subs, asubs)], *[F.col(x).alias(f"p{x}") for x in g.cols], "salt")
        cb = cf.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], *[F.col(x).alias(y) for x, y in zip(subs, bsubs)],
                       *[F.col(x).alias(f"q{x}") for x in g.cols], F.col("salt").alias("bsalt"))
        step = g.hot.expand(pairs.select("node1", "node2", *g.cells, *g.tcells, *asubs, *bsubs), key_cols=g.cells)
        step = step.join(ca, on=g.cells + asubs + ["salt"])
        step = g.hot.expand(step.drop("salt"), key_cols=g.tcells).withColumnRenamed("salt", "bsalt")
        step = step.join(cb, on=g.tcells + bsubs + ["bsalt"])
        return step.filter(g.pair_d2() <= F.lit(g.r2)).select("node1", "node2", *g.cells).distinct()

    certain_edges, open_ = settle(sp)
    # undecided pairs with few points are compared directly; heavy ones are refined:
    # each side split into 2^d children and re-tested on boxes, up to refine_levels
    heavy = (F.col("ka").cast("double") * F.col("kb").cast("double")) > F.lit(float(REFINE_MIN_WORK))
    refined = [certain_edges]
    point_edges = point_links(open_.filter(~heavy), 0)
    for level in range(1, refine_levels + 1):
        big = open_.filter(heavy)
        if big.isEmpty():
            break
        cl = cores.select(
            *g.cells, *[e.alias(f"p{x}") for e, x in zip(_sub_exprs(g, m, level - 1), subs)], *_sub_exprs(g, m, level, subs), *g.cols
        )
        kid = cl.groupBy(*g.cells, *[f"p{x}" for x in subs], *subs).agg(
            F.count(F.lit(1)).alias("k"), *[F.min(x).alias(l) for x, l in zip(g.cols, lo)], *[F.max(x).alias(h) for x, h in zip(g.cols, hi)]
        )
        ka = kid.select(*g.cells, *[F.col(f"p{x}").alias(y) for x, y in zip(subs, asubs)],
                        *[F.col(x).alias(f"n{y}") for x, y in zip(subs, asubs)], F.col("k").alias("nka"), *[F.col(x).alias(f"a{x}") for x in lo + hi])
        kb = kid.select(*[F.col(c).alias(t) for c, t in zip(g.cells, g.tcells)], *[F.col(f"p{x}").alias(y) for x, y in zip(subs, bsubs)],
                        *[F.col(x).alias(f"n{y}") for x, y in zip(subs, bsubs)], F.col("k").alias("nkb"), *[F.col(x).alias(f"b{x}") for x in lo + hi])
        kids = big.drop("ka", "kb").join(ka, on=g.cells + asubs).join(kb, on=g.tcells + bsubs)
        kids = kids.drop(*asubs, *bsubs).select(
            "*", *[F.col(f"n{y}").alias(y) for y in asubs + bsubs], F.col("nka").alias("ka"), F.col("nkb").alias("kb")
        )
        kids = checkpoint(classify(kids))
        sure, open_ = settle(kids)
        refined.append(sure)
        last = level == refine_levels
        point_edges = point_edges.unionByName(point_links(open_ if last else open_.filter(~heavy), level))
    if refine_levels == 0:
        point_edges = point_edges.unionByName(point_links(open_.filter(heavy), 0))
    certain_edges = refined[0]
    for r in refined[1:]:
        certain_edges = certain_edges.unionByName(r)
    edges = rep_links.unionByName(certain_edges).unionByName(point_edges)
    labels = connected_components(
        corecells.select(F.col("node").alias("id")),
        edges.select(F.col("node1").alias("src"), F.col("node2").alias("dst"), *g.cells),
        locality=g.cells,
    )
    cell_label = corecells.join(labels.withColumnRenamed("id", "node"), on="node").select(*g.cells, "cluster_id")
    return cores.join(g.hot.expand(cell_label), on=g.cells + ["salt"])
