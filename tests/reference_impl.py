"""Brute-force NumPy references for the tests (small inputs only)."""

from __future__ import annotations

import numpy as np


def d2_matrix(x: np.ndarray) -> np.ndarray:
    diff = x[:, None, :] - x[None, :, :]
    d2 = np.zeros(diff.shape[:2])
    for c in range(x.shape[1]):  # coordinate order
        d2 = d2 + diff[:, :, c] * diff[:, :, c]
    return d2


def components(n: int, edges) -> list[int]:
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def dbscan(ids, x, eps, min_pts, core_mask=None):
    """Returns {id: (role, cluster_id)} with the library's semantics."""
    ids = np.asarray(ids)
    x = np.asarray(x, dtype=np.float64)
    n = len(ids)
    if n == 0:
        return {}
    d2 = d2_matrix(x)
    nb = d2 <= eps * eps
    cnt = nb.sum(1)
    core = cnt >= min_pts if core_mask is None else np.asarray(core_mask)
    order = np.argsort(ids)  # index by id order so component roots are smallest ids
    pos = {i: k for k, i in enumerate(order)}
    edges = [(pos[i], pos[j]) for i in range(n) for j in range(n) if i != j and core[i] and core[j] and nb[i, j]]
    comp = components(n, edges)
    out = {}
    for i in range(n):
        if core[i]:
            out[int(ids[i])] = ("core", int(ids[order[comp[pos[i]]]]))
    for i in range(n):
        if core[i]:
            continue
        cands = [(d2[i, j], int(ids[j])) for j in range(n) if core[j] and nb[i, j]]
        if cands:
            _, cid = min(cands)
            out[int(ids[i])] = ("border", out[cid][1])
        else:
            out[int(ids[i])] = ("noise", -1)
    return out
