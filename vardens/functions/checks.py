"""Argument checks that run on the driver before any job starts."""

from __future__ import annotations

import math


def check_eps(eps: float, name: str = "eps") -> float:
    if eps is None or not isinstance(eps, (int, float)) or math.isnan(eps) or math.isinf(eps) or eps <= 0:
        raise ValueError(f"{name} must be a positive finite number, got {eps!r}")
    return float(eps)


def check_min_pts(min_pts: int, name: str = "min_pts") -> int:
    if isinstance(min_pts, bool) or not isinstance(min_pts, int) or min_pts < 1:
        raise ValueError(f"{name} must be an integer >= 1, got {min_pts!r}")
    return min_pts


def check_unit(value: float, name: str) -> float:
    if value is None or not isinstance(value, (int, float)) or math.isnan(value) or not (0 < value <= 1):
        raise ValueError(f"{name} must be in (0, 1], got {value!r}")
    return float(value)
