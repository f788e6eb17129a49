"""Column expressions for points on a grid: cells, squared distances, box distances.

Distances are always *squared* and built as ``dx*dx`` summed in coordinate order, and
compared with ``eps*eps`` computed once in Python.  Because IEEE subtraction,
multiplication and addition are monotone, a box distance built the same way from the
actual min/max coordinates of a group of points bounds every point-to-point distance of
the group in the same floating-point arithmetic; the box tests below are therefore exact,
with no tolerance.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slack factor for cell sides: keeps a pair at exactly eps inside the searched
# neighbourhood under rounding.  Fixed value.
CELL_SLACK = 1e-9


def coord_names(d: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def cell_names(d: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def contraction_side(eps: float, d: int) -> float:
    """Cell side whose diagonal is below eps: all points of one cell are mutual neighbours."""
    return eps / math.sqrt(d) * (1.0 - CELL_SLACK)


def reach(side: float, radius: float) -> int:
    """How many cells away a point within ``radius`` can lie."""
    return int(math.floor(radius / side)) + 1


def offsets(d: int, k: int, forward_only: bool = False) -> list[tuple[int, ...]]:
    """All cell offsets in [-k, k]^d; ``forward_only`` keeps those lexicographically > 0."""
    out = []
    for o in itertools.product(range(-k, k + 1), repeat=d):
        if forward_only and not (o > tuple([0] * d)):
            continue
        out.append(o)
    return out


def cell_exprs(cols: Sequence[str], side: float, names: Sequence[str]) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(side)).cast("long").alias(n) for c, n in zip(cols, names)]


def with_neighbour_cells(df, cells: Sequence[str], targets: Sequence[str], offs: list[tuple[int, ...]]):
    """One row per (row, offset): ``targets`` = ``cells`` + offset."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in offs])
    out = df.withColumn("_off", F.explode(arr))
    out = out.select("*", *[(F.col(c) + F.col(f"_off.o{i}")).alias(t) for i, (c, t) in enumerate(zip(cells, targets))])
    return out.drop("_off")


def sqdist(a: Sequence[str | Column], b: Sequence[str | Column]) -> Column:
    """Squared Euclidean distance, ``dx*dx`` summed in coordinate order."""
    total = None
    for x, y in zip(a, b):
        dx = F.col(x) - F.col(y) if isinstance(x, str) else x - (F.col(y) if isinstance(y, str) else y)
        term = dx * dx
        total = term if total is None else total + term
    return total


def box_min_sqdist(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Smallest squared distance between two boxes (lists of column names)."""
    total = None
    for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b):
        gap = F.greatest(F.lit(0.0), F.col(lb) - F.col(ha), F.col(la) - F.col(hb))
        term = gap * gap
        total = term if total is None else total + term
    return total


def box_max_sqdist(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Largest squared distance between two boxes."""
    total = None
    for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b):
        span = F.greatest(F.col(hb) - F.col(la), F.col(ha) - F.col(lb))
        term = span * span
        total = term if total is None else total + term
    return total


def finite(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
