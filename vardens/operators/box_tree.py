"""Points in blocks under a tree of counted boxes, and searches whose blocks meet (2-3-d).

Points of equal coordinates are one *location* (a count and its smallest ids).  Locations
are range-partitioned in Z-order; a task cuts its sorted stream into chunks and a chunk, by
medians of its longest axis, into *blocks* of at most ``leaf`` locations, a row each.  Every
``FAN`` blocks in that order are a box of the next level, up to one root, so all blocks stand
equally deep however uneven the data, a location is written once, and what a task holds is
bounded by ``CHUNK`` and ``leaf``.

A search descends pairs of boxes (``descended``, a row a pair) down to the pairs of blocks
that bounds leave open.  These meet in tiles of ``FAN`` asking blocks (``meet``): a task holds
a tile, and each block that some block of it still has to meet passes by once.  There, runs of
``SUB`` locations have boxes of their own, and only locations of runs that straddle a bound
are compared.

Box distances are exact bounds in floating point (see ``functions.geometry``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_min_sqdist
from ..session import bounded_map, checkpoint
from .skew import DEFAULT_MAX_BROADCAST_ROWS, find_hot_keys

#: Most locations of a block; locations of a run with a box of its own inside a block.
LEAF, SUB = 512, 16
#: Boxes of a level under one of the next, as bits.
FAN_BITS = 4
#: Locations cut into blocks at a time; locations of a range partition.
CHUNK, PART_ROWS = 1 << 15, 1 << 16
#: Bits of an axis in the Z-order.
Z_BITS = 20


@dataclass
class BoxTree:
    """``blocks``: ``b, w`` (points), ``lo.., hi.., x..`` (arrays), ``m, held, ids[, label]``;
    ``nodes``: ``lv, b, w, lo.., hi..``, level 0 being the blocks; ``locs``: every location
    (coordinates, ``m`` points, smallest ``ids``)."""

    blocks: DataFrame
    nodes: DataFrame
    locs: DataFrame
    cols: list[str]
    top: int
    tasks: int

    @property
    def lo(self) -> list[str]:
        return [f"lo{i}" for i in range(len(self.cols))]

    @property
    def hi(self) -> list[str]:
        return [f"hi{i}" for i in range(len(self.cols))]

    def side(self, level: int, name: str) -> DataFrame:
        """The boxes of a level as ``name, nameup, namew, namelo.., namehi..``."""
        here = self.nodes.filter(F.col("lv") == level)
        return here.select(
            F.col("b").alias(name), F.shiftright("b", FAN_BITS).alias(f"{name}up"),
            *[F.col(c).alias(f"{name}{c}") for c in ("w", *self.lo, *self.hi)],
        )

    def corners(self) -> list[list[str]]:
        return [[s + c for c in names] for s in "ab" for names in (self.lo, self.hi)]


def _locations(points: DataFrame, cols: list[str], keep: int, label: str | None) -> DataFrame:
    """One row per place: ``cols, m`` and its ``keep`` smallest ids (and the ``label`` of the
    smallest).  Counts and ends are combined before anything is shuffled; only the points of
    places with more than two are read again, their ids cut by a window's group limit."""
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *([label] if label else []))))
    one = points.groupBy(*cols).agg(F.count(F.lit(1)).alias("m"), F.count("id").alias("known"), least.alias("s"), F.max("id").alias("most"))
    ids = F.slice(F.array("s.id", "most"), 1, F.least(F.col("known"), F.lit(min(keep, 2))).cast("int"))
    rest = [F.col(f"s.{label}").alias("label")] if label else []
    one = checkpoint(one.select(*cols, "m", ids.alias("ids"), *rest))
    if keep <= 2 or one.filter("m > 2").isEmpty():
        return one
    w = Window.partitionBy(*cols).orderBy("id")
    crowd = points.select("id", *cols).filter("id is not null").join(one.filter("m > 2").select(*cols), on=cols, how="left_semi")
    crowd = crowd.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
    crowd = crowd.groupBy(*cols).agg(F.sort_array(F.collect_list("id")).alias("more"))
    out = one.join(crowd, on=cols, how="left")
    return checkpoint(out.select(*cols, "m", F.coalesce("more", "ids").alias("ids"), *(["label"] if label else [])))


def bounding_cube(points: DataFrame, cols: list[str]) -> tuple[list[float], float]:
    """Low corner and side of the cube around ``points`` (a unit cube without any)."""
    st = points.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    if st["a0"] is None:
        return [0.0] * len(cols), 1.0
    low = [st[f"a{i}"] + 0.0 for i in range(len(cols))]
    span = max(st[f"b{i}"] - a for i, a in enumerate(low)) or 1.0
    if not math.isfinite(span):
        raise ValueError("coordinates are too far apart for a double")
    return low, span


def _z_order(cols: list[str], low: list[float], span: float) -> Column:
    top, total = float(2**Z_BITS), F.lit(0).cast("long")
    for i, (c, a) in enumerate(zip(cols, low)):
        cell = F.least(F.floor((F.col(c) - F.lit(a)) / F.lit(span) * F.lit(top)).cast("long"), F.lit(2**Z_BITS - 1))
        for bit in range(Z_BITS):
            total = total + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), bit * len(cols) + i)
    return total


def _halved(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``x`` and the starts of blocks of at most ``leaf`` rows in it:
    halves by the longest axis, down to runs of at most ``SUB`` rows within a block."""
    parts, starts, at = [], [], 0
    todo = [(np.arange(len(x)), False)]
    while todo:
        rows, inside = todo.pop()
        if not inside and len(rows) <= leaf:
            starts.append(at)
            inside = True
        if len(rows) <= min(SUB, leaf):
            parts.append(rows)
            at += len(rows)
            continue
        axis = np.argmax(np.ptp(x[rows], axis=0))
        half = len(rows) // 2
        if inside and len(rows) > SUB:  # whole runs
            half = max(SUB, half // SUB * SUB)
        rows = rows[np.argpartition(x[rows, axis], half)]
        todo += [(rows[half:], inside), (rows[:half], inside)]
    return np.concatenate(parts), np.array(starts)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _cut(chunk: pa.Table, cols: list[str], part: int, seq: int, leaf: int, names: list[str]) -> pa.RecordBatch:
    x = np.stack([chunk.column(c).to_numpy() for c in cols], axis=1)
    order, starts = _halved(x, leaf)
    x, chunk = x[order], chunk.take(pa.array(order)).combine_chunks()
    ids = chunk.column("ids").combine_chunks()
    ids = ids if isinstance(ids, pa.ListArray) else ids.chunk(0)
    held = np.diff(np.asarray(ids.offsets)).astype(np.int64)
    m = chunk.column("m").to_numpy()
    ends = np.append(starts, len(x))
    out = [
        pa.array(np.full(len(starts), part, np.int64)), pa.array(seq + np.arange(len(starts), dtype=np.int64)),
        pa.array(np.add.reduceat(m, starts)),
        *[pa.array(np.minimum.reduceat(x[:, i], starts)) for i in range(len(cols))],
        *[pa.array(np.maximum.reduceat(x[:, i], starts)) for i in range(len(cols))],
        *[_lists(x[:, i], ends) for i in range(len(cols))], _lists(m, ends), _lists(held, ends),
        _lists(np.asarray(ids.flatten()), np.append(0, np.cumsum(held))[ends]),
    ]
    if "label" in names:
        out.append(_lists(chunk.column("label").to_numpy(), ends))
    return pa.RecordBatch.from_arrays(out, names)


def build_tree(points: DataFrame, cols: list[str], keep: int, leaf: int = LEAF, label: str | None = None) -> BoxTree | None:
    """The tree over ``points`` (``id``, finite ``cols``); None when there are none."""
    d = len(cols)
    if d > 3:
        raise ValueError("a tree takes 1 to 3 coordinate columns")
    locs = _locations(points, cols, keep, label)
    n = locs.count()
    if not n:
        return None
    lo, hi = [f"lo{i}" for i in range(d)], [f"hi{i}" for i in range(d)]
    names = ["part", "seq", "w", *lo, *hi, *cols, "m", "held", "ids", *(["label"] if label else [])]
    parts = max(1, math.ceil(n / PART_ROWS))
    low, span = bounding_cube(locs, cols)
    dealt = locs.withColumn("z", _z_order(cols, low, span)).repartitionByRange(parts, "z", *cols).sortWithinPartitions("z", *cols)

    def cut(batches):
        part, seq, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            while size >= 2 * CHUNK:
                table = pa.Table.from_batches(waiting)
                out = _cut(table.slice(0, CHUNK), cols, part, seq, leaf, names)
                yield out
                seq, size, waiting = seq + out.num_rows, size - CHUNK, table.slice(CHUNK).to_batches()
        if size:
            yield _cut(pa.Table.from_batches(waiting), cols, part, seq, leaf, names)

    kinds = ["part long", "seq long", "w long", *[f"{c} double" for c in lo + hi], *[f"{c} array<double>" for c in cols]]
    kinds += ["m array<long>", "held array<long>", "ids array<long>", *(["label array<long>"] if label else [])]
    made = checkpoint(bounded_map(dealt.drop("z"), cut, ", ".join(kinds)))
    last = made.agg(F.max("seq").alias("s"), F.max("part").alias("p")).first()
    bits = -(-last["s"].bit_length() // FAN_BITS) * FAN_BITS
    top = -(-(last["p"] << bits | last["s"]).bit_length() // FAN_BITS)
    b = F.shiftleft("part", bits).bitwiseOR(F.col("seq"))
    blocks = made.select(b.alias("b"), *names[2:])
    up = blocks.select("b", "w", *lo, *hi).withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
    up = up.withColumn("b", F.expr(f"shiftright(b, {FAN_BITS} * lv)"))
    nodes = checkpoint(up.groupBy("lv", "b").agg(F.sum("w").alias("w"), *[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi]))
    most = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (4 * PART_ROWS))
    return BoxTree(blocks, nodes, locs, cols, top, max(1, min(most, math.ceil(n / (leaf << FAN_BITS - 1)))))


def opened(state: DataFrame, tree: BoxTree, name: str, level: int) -> DataFrame:
    """``state`` with the boxes of a side replaced by their children at ``level``."""
    kids = tree.side(level, name)
    keep = [c for c in state.columns if c not in kids.columns]
    at = state.select(*keep, F.col(name).alias(f"{name}up"))
    return at.join(kids, f"{name}up").drop(f"{name}up")


def root_pair(asking: BoxTree, asked: BoxTree) -> DataFrame:
    a, b = asking.side(asking.top, "a"), asked.side(asked.top, "b")
    return a.drop("aup").join(b.drop("bup"), F.col("a") == F.col("b"))  # both roots are box 0


def descended(asking: BoxTree, asked: BoxTree, state: DataFrame, judged, bound: Column, ended=None) -> DataFrame:
    """The pairs of blocks that ``judged`` leaves, from the pair of roots (``state``).  A round
    opens both sides of every pair, no farther apart than ``bound``; a tree that has come to its
    blocks waits for the other.  ``ended`` takes from the judged rows those that end there."""
    la, lb = asking.top, asked.top
    near = box_min_sqdist(*asking.corners())
    while True:
        state = checkpoint(judged(state, la))
        if ended is not None:
            state = ended(state, la)
        if la == 0 and lb == 0:
            return state
        if la and la >= lb:
            la -= 1
            state = opened(state, asking, "a", la).filter(near <= bound)
            if lb > la:
                lb -= 1
                state = opened(state, asked, "b", lb)
        else:
            lb -= 1
            state = opened(state, asked, "b", lb)


# ------------------------------------------------------------------ blocks that meet


@dataclass
class Runs:
    """Locations in runs of ``SUB``, padded with NaN (which no comparison holds for)."""

    x: np.ndarray  # runs, SUB, d
    m: np.ndarray  # runs, SUB
    real: np.ndarray  # runs, SUB
    lo: np.ndarray
    hi: np.ndarray
    more: dict = field(default_factory=dict)

    def far_near(self, other: Runs, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest squared distances of runs ``mine`` from the other's runs."""
        far = near = 0.0
        for c in range(self.x.shape[2]):
            lo, hi = self.lo[mine, c, None], self.hi[mine, c, None]
            span = np.maximum(other.hi[None, :, c] - lo, hi - other.lo[None, :, c])
            gap = np.maximum(0.0, np.maximum(other.lo[None, :, c] - hi, lo - other.hi[None, :, c]))
            far, near = far + span * span, near + gap * gap
        return far, near

    def d2(self, i: np.ndarray, other: Runs, j: np.ndarray) -> np.ndarray:
        total = 0.0
        for c in range(self.x.shape[2]):
            diff = self.x[i, :, None, c] - other.x[j, None, :, c]
            total = total + diff * diff
        return total


def runs_of(xs: list[np.ndarray], m: np.ndarray) -> Runs:
    n = len(m)
    k = -(-n // SUB)
    x = np.full((k * SUB, len(xs)), np.nan)
    x[:n] = np.stack(xs, axis=1)
    mm = np.zeros(k * SUB, np.int64)
    mm[:n] = m
    real = (np.arange(k * SUB) < n).reshape(k, SUB)
    x = x.reshape(k, SUB, -1)
    return Runs(x, mm.reshape(k, SUB), real, np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1))


def joined_runs(parts: list[Runs]) -> Runs:
    return Runs(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("x", "m", "real", "lo", "hi")])


#: Pairs of runs compared at a time (of ``SUB * SUB`` distances each).
RUN_PAIRS = 2048


def meet(asking: BoxTree, asked: BoxTree, ends: DataFrame, own: DataFrame, extra: list[str], begin, pass_by, finish, schema: str) -> DataFrame:
    """The rows of ``finish(tile)`` for all tiles of ``FAN`` asking blocks.

    ``own`` is ``b`` and values of asking blocks by the names ``extra`` (longs or doubles);
    ``ends`` is ``a, b, near`` and flags ``open`` (an int) of pairs of blocks.  ``begin`` makes
    a tile of its blocks' rows, ``pass_by(tile, row, places, flags)`` is called for each block
    that blocks at ``places`` of the tile meet, nearest first."""
    cols = asking.cols
    label = "label" in asked.blocks.columns
    none = F.lit(None)
    what = ["b", *cols, "m", "held", "ids"]
    a = asking.blocks.select(*what).join(own.select("b", *extra), "b", "left") if extra else asking.blocks.select(*what)
    a = a.select(
        F.shiftright("b", FAN_BITS).alias("tile"), F.lit(-1.0).alias("near"), *what, *extra,
        none.cast("array<long>").alias("label"), none.cast("array<long>").alias("of"), none.cast("array<long>").alias("flags"),
    )
    p = ends.groupBy(F.shiftright("a", FAN_BITS).alias("tile"), "b").agg(
        F.min("near").alias("near"), F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("open").cast("long").alias("open"))).alias("l")
    )
    p = p.join(asked.blocks.select(*what, *(["label"] if label else [])), "b").select(
        "tile", "near", *what, *[none.cast("double").alias(e) for e in extra],
        F.col("label") if label else none.cast("array<long>").alias("label"), F.col("l.a").alias("of"), F.col("l.open").alias("flags"),
    )
    a = a.select(*[F.col(c).cast("double").alias(c) if c in extra else F.col(c) for c in a.columns])
    rows = a.unionByName(p).repartition(asking.tasks, "tile").sortWithinPartitions("tile", "near", "b")

    def task(batches):
        of, mine, tile, places = None, [], None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                key = row["tile"].as_py()
                if key != of:
                    if mine or tile is not None:
                        yield from finish(tile if tile is not None else begin(mine))
                    of, mine, tile, places = key, [], None, {}
                at = {c: np.asarray(row[c].values) for c in (*cols, "m", "held", "ids")}
                at |= {e: row[e].as_py() for e in extra} | {"b": row["b"].as_py()}
                if not row["of"].is_valid:
                    places[at["b"]] = len(mine)
                    mine.append(at)
                    continue
                if tile is None:
                    tile = begin(mine)
                if label:
                    at["label"] = np.asarray(row["label"].values)
                pass_by(tile, at, np.array([places[x] for x in row["of"].as_py()]), np.array(row["flags"].as_py()))
        if mine or tile is not None:
            yield from finish(tile if tile is not None else begin(mine))

    return bounded_map(rows, task, schema)


def in_steps(i: np.ndarray, near: np.ndarray, far: np.ndarray):
    """Places of the pairs of runs ``i`` and others: first the nearest of each run, which
    lowers the bounds, then the rest, nearest first."""
    order = np.lexsort((far, near, i))
    first = np.diff(i[order], prepend=-1) != 0
    rest = order[~first]
    rest = rest[np.argsort(near[rest], kind="stable")]
    yield order[first]
    for at in range(0, len(rest), RUN_PAIRS):
        yield rest[at : at + RUN_PAIRS]


def tile_runs(mine: list[dict], cols: list[str]) -> tuple[Runs, np.ndarray]:
    """The runs of a tile's blocks and the block of each run."""
    parts = [runs_of([r[c] for c in cols], r["m"]) for r in mine]
    return joined_runs(parts), np.repeat(np.arange(len(mine)), [len(p.m) for p in parts])


# ------------------------------------------------------------------ nearest others


def _ids_of(rows: list[dict], cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest ids of the locations, and the first of each location (and the end)."""
    held = np.concatenate([r["held"] for r in rows])
    return np.concatenate([r["ids"] for r in rows]), np.append(0, np.cumsum(held))


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that each stand for ``first[w]:first[w + 1]``: places in ``which`` and in the list."""
    n = first[which + 1] - first[which]
    at = np.repeat(np.arange(len(which)), n)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, first[which[at]] + inner


class _Near:
    """The ``k`` nearest others of a tile's locations, by distance, then id."""

    def __init__(self, mine: list[dict], cols: list[str], k: int):
        self.k, self.cols = k, cols
        self.runs, self.block = tile_runs(mine, cols)
        self.ids, self.first = _ids_of(mine, cols)
        shape = self.runs.m.shape
        self.slot = np.cumsum(self.runs.real.ravel()).reshape(shape) - 1  # number of a real location
        n = int(self.runs.real.sum())
        self.ub = np.full(n, np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # location, d2, id
        asks = self.runs.real & (self.runs.m <= k)
        self.asks = np.zeros(n, bool)
        self.asks[self.slot[asks]] = True

    def bounds(self) -> np.ndarray:
        """Of each run, the largest bound of its asking locations (-1 without any)."""
        of = np.where(self.runs.real, np.where(self.asks, self.ub, -1.0)[self.slot], -1.0)
        return of.max(axis=1)

    def compare(self, other: Runs, ids: np.ndarray, first: np.ndarray, slot: np.ndarray, places: np.ndarray, same: np.ndarray | None) -> None:
        mine = np.flatnonzero(np.isin(self.block, places))
        far, near = self.runs.far_near(other, mine)
        bound = self.bounds()[mine]
        if same is not None:  # runs of the same block, nearest runs first
            near = np.where(same[mine][:, None] == same[None, :], near, np.inf)
        i, j = np.nonzero((near <= bound[:, None]) & (near < np.inf))
        gap, far = near[i, j], far[i, j]
        i = mine[i]
        for u in in_steps(i, gap, far):
            ii, jj = i[u], j[u]
            keep = gap[u] <= self.bounds()[ii]
            ii, jj = ii[keep], jj[keep]
            if not len(ii):
                continue
            d2 = self.runs.d2(ii, other, jj)
            ub = np.where(self.runs.real, np.where(self.asks, self.ub, -1.0)[self.slot], -1.0)[ii]
            p, q, r = np.nonzero(d2 <= ub[:, :, None])
            mine_at, there, dist = self.slot[ii[p], q], slot[jj[p], r], d2[p, q, r]
            if same is not None:
                other_place = mine_at != there
                mine_at, there, dist = mine_at[other_place], there[other_place], dist[other_place]
            if len(mine_at):
                self.add(mine_at, there, dist, ids, first)

    def add(self, mine_at: np.ndarray, there: np.ndarray, dist: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        at, inner = _spread(first, there)
        touched = np.zeros(len(self.ub), bool)
        touched[mine_at] = True
        old = touched[self.found[0]]
        who = np.concatenate([self.found[0][old], mine_at[at]])
        d2 = np.concatenate([self.found[1][old], dist[at]])
        nbr = np.concatenate([self.found[2][old], ids[inner]])
        order = np.lexsort((nbr, d2, who))
        who, d2, nbr = who[order], d2[order], nbr[order]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        kth = rank == self.k - 1
        self.ub[who[kth]] = d2[kth]
        keep = rank < self.k
        self.found = tuple(np.concatenate([f[~old], g[keep]]) for f, g in zip(self.found, (who, d2, nbr)))

    def within(self) -> None:
        """Each block against itself."""
        places = np.unique(self.block)
        self.compare(self.runs, self.ids, self.first, self.slot, places, self.block)

    def meet(self, row: dict, places: np.ndarray) -> None:
        other = runs_of([row[c] for c in self.cols], row["m"])
        slot = np.cumsum(other.real.ravel()).reshape(other.m.shape) - 1
        self.compare(other, row["ids"], np.append(0, np.cumsum(row["held"])), slot, places, None)

    def answers(self) -> pa.RecordBatch:
        """``id, rank, nbr, d2``: others at the place itself and the nearest elsewhere."""
        who, d2, nbr = self.found
        at = np.repeat(np.arange(len(self.ub)), np.diff(self.first))
        keep = self.asks[at]
        pid, at = self.ids[keep], at[keep]  # one asker per id of a place
        here, inner = _spread(self.first, at)
        order = np.argsort(who, kind="stable")
        who, d2, nbr = who[order], d2[order], nbr[order]
        start = np.searchsorted(who, np.arange(len(self.ub) + 1))
        there, more = _spread(start, at)
        asker = np.concatenate([here, there])
        out = np.concatenate([np.zeros(len(here)), d2[more]])
        got = np.concatenate([self.ids[inner], nbr[more]])
        other = got != pid[asker]
        asker, out, got = asker[other], out[other], got[other]
        order = np.lexsort((got, out, asker))
        asker, out, got = asker[order], out[order], got[order]
        start = np.flatnonzero(np.diff(asker, prepend=-1))
        rank = 1 + np.arange(len(asker)) - np.repeat(start, np.diff(np.append(start, len(asker))))
        keep = rank <= self.k
        return pa.RecordBatch.from_arrays(
            [pa.array(pid[asker[keep]]), pa.array(rank[keep].astype(np.int32)), pa.array(got[keep]), pa.array(out[keep])],
            ["id", "rank", "nbr", "d2"],
        )


def _bounds(tree: BoxTree, k: int) -> DataFrame:
    """``lv, b, ub``: no location of the box has its ``k``-th other beyond ``ub``: of a block the
    largest distance found within it, else the diagonal of the first box above with ``2 k``."""
    cols = tree.cols

    def own(batches):
        for batch in batches:
            out = []
            for k_row in range(batch.num_rows):
                row = {c: np.asarray(batch.column(c)[k_row].values) for c in (*cols, "m", "held", "ids")}
                near = _Near([row], cols, k)
                near.within()
                out.append(float(near.ub[near.asks].max(initial=-1.0)))
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(out, pa.float64())], ["b", "ub"])

    ub = bounded_map(tree.blocks.select("b", *cols, "m", "held", "ids"), own, "b long, ub double")
    diagonal = None
    for lo, hi in zip(tree.lo, tree.hi):
        side = F.col(hi) - F.col(lo)
        diagonal = side * side if diagonal is None else diagonal + side * side
    full = tree.nodes.filter(F.col("w") >= F.lit(2 * k)).select("lv", F.col("b").alias("n"), diagonal.alias("diagonal"))
    ub = checkpoint(ub)
    lone = ub.filter(F.col("ub") == float("inf")).select("b", F.explode(F.sequence(F.lit(0), F.lit(tree.top))).alias("lv"))
    lone = lone.withColumn("n", F.expr(f"shiftright(b, {FAN_BITS} * lv)")).join(full, ["lv", "n"])
    lone = lone.groupBy("b").agg(F.min("diagonal").alias("diagonal"))
    ub = ub.join(lone, "b", "left").select("b", F.least("ub", F.coalesce("diagonal", F.lit(float("inf")))).alias("ub"))
    ub = ub.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(tree.top)))).withColumn("b", F.expr(f"shiftright(b, {FAN_BITS} * lv)"))
    return checkpoint(ub.groupBy("lv", "b").agg(F.max("ub").alias("ub")))


def _same_place(
    points: DataFrame, tree: BoxTree, k: int, hot_rows: int, max_broadcast_rows: int
) -> DataFrame:
    """Neighbours of the points at places that hold more than ``k``: all at distance 0."""
    full = tree.locs.filter(F.col("m") > F.lit(k))
    hot = find_hot_keys(full, tree.cols, "m", hot_rows, max_broadcast_rows)
    rows = hot.salt_rows(points.select("id", *tree.cols)).join(hot.expand(full), on=[*tree.cols, "salt"])
    others = F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, k)
    return rows.select("id", F.posexplode(others).alias("at", "nbr")).select(
        "id", (F.col("at") + 1).alias("rank"), "nbr", F.lit(0.0).alias("d2")
    )


def nearest(
    points: DataFrame, cols: list[str], k: int, hot_rows: int, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    leaf: int = LEAF,
) -> DataFrame | None:
    """``id, rank, nbr, d2``: the ``k`` nearest others of each of ``points``, by distance,
    then id; None when there are no points.

    The ``k``-th distance within its own block bounds a location's search, the largest of a
    block its pairs with other blocks, found by descending the tree.  A block is met by the
    tiles whose bound reaches it; only runs within a location's own bound are compared.
    """
    tree = build_tree(points, cols, keep=k + 1, leaf=leaf)
    if tree is None:
        return None
    bounds = _bounds(tree, k)

    def judged(state: DataFrame, level: int) -> DataFrame:
        state = state.withColumn("near", box_min_sqdist(*tree.corners()))
        at = bounds.filter(F.col("lv") == level).select(F.col("b").alias("a"), "ub")
        state = state.drop("ub").join(at, "a")
        return state.filter((F.col("near") <= F.col("ub")) & (F.col("ub") >= 0))

    ends = descended(tree, tree, root_pair(tree, tree), judged, F.col("ub")).filter(F.col("a") != F.col("b"))
    ends = ends.select("a", "b", "near", F.lit(0).alias("open"))

    def begin(mine):
        tile = _Near(mine, cols, k)
        tile.within()
        return tile

    def finish(tile):
        yield tile.answers()

    out = meet(
        tree, tree, ends, tree.blocks, [], begin, lambda tile, row, places, flags: tile.meet(row, places), finish,
        "id long, rank int, nbr long, d2 double",
    )
    if not tree.locs.filter(F.col("m") > F.lit(k)).isEmpty():
        out = out.unionByName(_same_place(points, tree, k, hot_rows, max_broadcast_rows))
    if not points.groupBy("id").count().filter(F.col("count") > 1).isEmpty():  # several rows of one id share its ranks
        w = Window.partitionBy("id").orderBy("d2", "nbr")
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("id", "rank", "nbr", "d2")
