"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Every entry ``c`` becomes the integer ``x = floor(scale * c)`` plus a constant, which cancels
in every result and is left out below; the *fit list* is each distinct ``x`` vector once.
``fit`` then works in integers as long as it can:

1. Spark packs the vectors (one byte an entry where that is enough), keeps each once and
   sums ``x`` and ``x x'`` exactly, task by task;
2. the scatter ``M = n * sum(x x') - S S'`` (``n`` squared times the covariance) is reduced
   to Hessenberg form modulo many primes, one Spark row a prime, and the characteristic
   polynomials are joined by Chinese remaindering to the one over the integers;
3. all its roots are real, so Descartes' rule of signs on a shifted polynomial *counts*
   the roots beyond a point; bisection by that count isolates the largest ones, with their
   multiplicity, to ``PRECISION`` bits below the trace;
4. inverse iteration on ``M - root``, in fixed-point integers of twice that precision, gives
   the null space: one unit vector a root, an orthonormal set for a repeated one.

Only ``d * d`` sums, ``d + 1`` coefficients a prime and the model reach the driver, all
bounded by the dimension.

Defined results: a vector that is null, empty or holds null or non-finite entries is left
out; so is one whose length differs from the commonest length among the distinct vectors
(ties: the longer).  ``scale * c`` beyond +-2**62 counts as +-2**62.  Repeated vectors count
once in the fit and each gets its rows in the result.  Roots that are zero have no
whitened coordinate and no component: a table without two distinct vectors gives no rows.
Roots equal to ``PRECISION`` bits count as one repeated root, where any orthonormal basis
will do.  A ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import arrow_map, bounded_map

SCALE, COMPONENTS = 64, 16
#: Bits below the trace to which roots are isolated.
PRECISION = 200
LIMB = 40


@dataclass
class Whitening:
    """What ``fit`` finds; ``roots`` are the eigenvalues of ``M``, one for each row of ``vectors``."""

    dim: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray
    scale: int
    identity_error: float | None = None

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows ``y``."""
        return self.centred(y).astype(np.float64) @ (self.vectors / np.sqrt(self.roots)[:, None]).T

    def centred(self, y: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: in 64 bits where they are enough, else in Python integers."""
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if self.dim * most * most < 2**63:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)


# ------------------------------------------------------------------ integer rows


def _integer_rows(column: pa.Array, scale: int):
    """``(rows, y)`` by vector length: the usable rows of a list column as integer matrices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()  # entries of null lists are left out, as their size is 0 here
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        block = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(block).all(axis=1)
        rows, block = rows[good], block[good]
        if len(rows):
            with np.errstate(over="ignore"):
                yield rows, np.clip(np.floor(scale * block), -(2.0**62), 2.0**62).astype(np.int64)


def _packed(y: np.ndarray) -> list[tuple[np.ndarray, pa.Array]]:
    """Rows as bytes: the width of an entry, then the entries; the least width that fits."""
    most = np.abs(y).max(axis=1)
    width = np.where(most < 2**7, 1, np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8)))
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        body = np.ascontiguousarray(y[at].astype(f"<i{w}")).view(np.uint8).reshape(len(at), -1)
        data = np.concatenate([np.full((len(at), 1), w, np.uint8), body], axis=1)
        ends = np.arange(len(at) + 1, dtype=np.int64) * data.shape[1]
        packed = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
        out.append((at, packed.cast(pa.binary())))
    return out


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Packed rows of ``dim`` entries as an integer matrix, in any order of rows."""
    parts = [np.zeros((0, dim), np.int64)]
    by_size: dict[int, list[bytes]] = {}
    for raw in column.to_pylist():
        by_size.setdefault(len(raw), []).append(raw)
    for size, raws in by_size.items():
        block = np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), size)[:, 1:]
        w = (size - 1) // dim
        parts.append(np.ascontiguousarray(block).view(f"<i{w}").astype(np.int64))
    return np.concatenate(parts)


def distinct_vectors(df: DataFrame, col: str, scale: int = SCALE) -> DataFrame:
    """``dim int, y binary``: every usable vector once, packed."""

    def rows(batch):
        for _, y in _integer_rows(batch.column(0), scale):
            for at, packed in _packed(y):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y.shape[1], np.int32)), packed], ["dim", "y"])

    return arrow_map(df.select(F.col(f"`{col}`").alias("v")), rows, "dim int, y binary").distinct()


# ------------------------------------------------------------------ exact sums


def _gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` as Python integers: by doubles in runs whose sums they hold exactly."""
    d, most = y.shape[1], int(np.abs(y).max(initial=0))
    if most >= 2**26:
        o = y.astype(object)
        return o.T @ o
    run, total = max(1, 2**53 // max(1, most * most)), np.zeros((d, d), object)
    for k in range(0, len(y), run):
        f = y[k : k + run].astype(np.float64)
        total += (f.T @ f).astype(np.int64).astype(object)
    return total


def _limbs(v: int) -> list[int]:
    """Five signed parts of ``LIMB`` bits, whose sums over tasks fit 64 bits."""
    sign, v, out = (1, v) if v >= 0 else (-1, -v), abs(v), []
    for _ in range(4):
        out.append(sign[0] * (v & (2**LIMB - 1)))
        v >>= LIMB
    return [*out, sign[0] * v]


def _summed(df: DataFrame, dim: int, sums) -> dict[tuple[int, int], int]:
    """Add up, over all batches, the integers that ``sums(y)`` gives as ``{(i, j): value}``."""
    names = [f"l{k}" for k in range(5)]

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            for key, v in sums(_unpacked(b.column(0), dim)).items():
                total[key] = total.get(key, 0) + v
        if total:
            keys = list(total)
            cols = np.array([_limbs(total[k]) for k in keys], np.int64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *map(pa.array, cols)],
                ["i", "j", *names],
            )

    parts = bounded_map(df.select("y"), run, "i int, j int, " + ", ".join(f"{k} long" for k in names))
    added = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])
    return {(r.i, r.j): sum(r[f"l{k}"] << (LIMB * k) for k in range(5)) for r in added.collect()}


def _moments(df: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and sums of products of the packed rows."""

    def sums(y):
        out = {(-1, -1): len(y)}
        # sums of products of columns with a column of ones are the sums
        g = _gram(np.concatenate([y, np.ones((len(y), 1), np.int64)], axis=1))
        for i in range(dim + 1):
            for j in range(i, dim + 1):
                out[i, j] = int(g[i, j])
        return out

    got = _summed(df, dim, sums)
    product = [[got[min(i, j), max(i, j)] for j in range(dim)] for i in range(dim)]
    return got[-1, -1], [got[i, dim] for i in range(dim)], product


# ------------------------------------------------------------------ characteristic polynomial


def _is_prime(p: int) -> bool:
    """Miller-Rabin; these bases decide every p below 3,215,031,751."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        if not any((x := x * x % p) == p - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, downwards, until their product exceeds ``bound``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def charpoly_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of ``det(x - m)`` modulo ``p``, lowest first, by Hessenberg reduction."""
    h = np.array([[v % p for v in row] for row in m], np.int64)
    d = len(h)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1 :, c])
        if not len(below):
            continue
        r = c + 1 + int(below[0])
        if r != c + 1:
            h[[r, c + 1]] = h[[c + 1, r]]
            h[:, [r, c + 1]] = h[:, [c + 1, r]]
        f = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2 :] = (h[c + 2 :] - f[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2 :] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        here = np.zeros(d + 1, np.int64)
        here[1:] = polys[k - 1, :-1]
        here = (here - h[k - 1, k - 1] * polys[k - 1] % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            here = (here - int(h[k - i - 1, k - 1]) * chain % p * polys[k - i - 1] % p) % p
        polys[k] = here
    return [int(v) for v in polys[d]]


def charpoly(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, lowest
    coefficient first: one Spark row a prime, joined by Chinese remaindering."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # the coefficients are elementary symmetric functions of roots >= 0 (Maclaurin's bound)
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_beyond(2 * bound)

    def run(batches):
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([charpoly_mod(m, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"]
            )

    tasks = spark.range(0, len(primes), 1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    rows = tasks.select(F.element_at(F.array(*map(F.lit, primes)), F.col("id").cast("int") + 1).alias("p")).mapInArrow(
        run, "p long, c array<long>"
    )
    product, residues = 1, [0] * (d + 1)
    for p, c in sorted(rows.collect()):
        step = pow(product % p, -1, p)
        residues = [r + product * ((v - r) * step % p) for r, v in zip(residues, c)]
        product *= p
    return [r if 2 * r < product else r - product for r in residues]


# ------------------------------------------------------------------ roots and null spaces


def _beyond(poly: list[int], a: int) -> int:
    """How many roots (all real, with multiplicity) of ``poly`` are greater than ``a``."""
    c = poly[::-1]  # highest first; Taylor shift by repeated synthetic division
    for k in range(len(c) - 1, 0, -1):
        for i in range(1, k + 1):
            c[i] += c[i - 1] * a
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], top: int, wanted: int) -> list[tuple[int, int]]:
    """``(root, multiplicity)`` of the largest positive roots below ``top``, falling, until
    ``wanted`` are named; roots are integers just below or at the true value."""

    def sign(a):
        v = 0
        for c in reversed(poly):
            v = v * a + c
        return (v > 0) - (v < 0)

    found, work = [], [(0, top, _beyond(poly, 0), 0)]
    while work and sum(m for _, m in found) < wanted:
        lo, hi, n_lo, n_hi = work.pop()
        if n_lo == n_hi:
            continue
        if n_lo - n_hi == 1:  # a simple root in (lo, hi]: its sign alone is enough
            at_lo = sign(lo)
            if at_lo == 0:  # a root just at lo belongs to the interval below
                at_lo = -sign(hi) if sign(hi) else (1 if n_lo % 2 == 0 else -1)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                s = sign(mid)
                if s == 0:
                    lo = hi = mid
                elif s == at_lo:
                    lo = mid
                else:
                    hi = mid
            found.append((hi, 1))
        elif hi - lo <= 1:
            found.append((hi, n_lo - n_hi))
        else:
            mid = (lo + hi) // 2
            n = _beyond(poly, mid)
            work += [(lo, mid, n_lo, n), (mid, hi, n, n_hi)]  # the upper half is taken first
    return found


def null_space(m: list[list[int]], root: int, k: int, count: int) -> list[list[int]]:
    """``count`` orthonormal vectors near the null space of ``m - root / 2**k``, as integers
    of ``2**bits``: Gaussian elimination in fixed point, then two steps of inverse iteration."""
    d = len(m)
    bits = 2 * PRECISION + 64
    a = np.array([[(v << k) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)], object)
    size = max(1, max(abs(int(v)) for v in a.flat)).bit_length()
    a = a << (bits - size) if size <= bits else a >> (size - bits)
    order, factors = list(range(d)), np.zeros((d, d), object)
    for c in range(d):
        r = c + max(range(d - c), key=lambda i: abs(a[c + i, c]))
        if r != c:
            a[[r, c]], factors[[r, c]] = a[[c, r]], factors[[c, r]]
            order[r], order[c] = order[c], order[r]
        if a[c, c] == 0:
            a[c, c] = 1  # the least number there is: the direction looked for
        f = np.array([(int(v) << bits) // int(a[c, c]) for v in a[c + 1 :, c]], object)
        factors[c + 1 :, c] = f
        if c + 1 < d:
            a[c + 1 :, c:] -= (f[:, None] * a[c, c:]) >> bits

    def solve(b):
        z = [b[i] for i in order]
        for i in range(d):
            z[i] -= sum(int(factors[i, j]) * z[j] for j in range(i)) >> bits
        for i in range(d - 1, -1, -1):
            z[i] = ((z[i] - (sum(int(a[i, j]) * z[j] for j in range(i + 1, d)) >> bits)) << bits) // int(a[i, i])
        return z

    def unit(z):
        top = max(1, max(map(abs, z)).bit_length())
        z = [v << (bits - top) if top <= bits else v >> (top - bits) for v in z]
        norm = max(1, isqrt(sum(v * v for v in z)))
        return [(v << bits) // norm for v in z]

    rng = np.random.default_rng(1)
    block = [[int(v) << (bits - 20) for v in rng.integers(-(2**20), 2**20, d)] for _ in range(count)]
    for _ in range(2):
        done: list[list[int]] = []
        for z in block:
            z = unit(solve(unit(z)))
            for _ in range(2):
                for u in done:
                    dot = sum(x * y for x, y in zip(u, z)) >> bits
                    z = [x - (dot * y >> bits) for x, y in zip(z, u)]
                z = unit(z)
            done.append(z)
        block = done
    return block


# ------------------------------------------------------------------ fit and use


def fit(df: DataFrame, col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a list column, or None if no vector can be used."""
    vectors = checkpoint(distinct_vectors(df, col, scale))
    best = vectors.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not best:
        return None
    dim = best[0]["dim"]
    vectors = vectors.filter(F.col("dim") == dim)
    n, sums, product = _moments(vectors, dim)
    m = [[n * product[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(m[i][i] for i in range(dim))
    model = Whitening(dim, n, sums, np.zeros((0, dim)), np.zeros(0), np.zeros(0), scale)
    if trace == 0:
        return model
    k = max(0, PRECISION - trace.bit_length())
    poly = [c << (k * (dim - i)) for i, c in enumerate(charpoly(df.sparkSession, m))]
    rows, roots = [], []
    for root, times in largest_roots(poly, (trace << k) + 1, components):
        for z in null_space(m, root, k, times):
            norm = isqrt(sum(v * v for v in z))
            flip = -1 if z[max(range(dim), key=lambda i: abs(z[i]))] < 0 else 1
            rows.append([flip * v / norm for v in z])
            roots.append(root)
    rows, roots = rows[:components], roots[:components]
    model.vectors = np.array(rows, np.float64).reshape(-1, dim)
    model.roots = np.array([r / (1 << k) for r in roots])
    model.explained = np.array([r / (trace << k) for r in roots])
    model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    dim, c = model.dim, len(model.roots)

    def run(batches):
        total = np.zeros((c, c))
        for b in batches:
            w = model.whiten(_unpacked(b.column(0), dim))
            total += w.T @ w
        i, j = np.indices((c, c)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    added = bounded_map(vectors.select("y"), run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return max(abs(r.v / model.n - (r.i == r.j)) for r in added.collect())


def transform(df: DataFrame, model: Whitening | None, carry: list[str], col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: ``carry``, then ``component, n, deviation,
    whitened, explained, identity_error``."""
    picked = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{col}`").alias("__vector"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    schema += ", component int, n long, deviation long, whitened double, explained double, identity_error double"

    def rows(batch):
        for at, y in _integer_rows(batch.column(len(carry)), model.scale):
            if y.shape[1] != model.dim:
                continue
            c, step = len(model.roots), max(1, 200_000 // len(model.roots))
            for k in range(0, len(at), step):
                part, run = at[k : k + step], y[k : k + step]
                far = model.centred(run)
                far = [v if v < 2**63 else None for v in (far * far).sum(axis=1).tolist()]
                idx = pa.array(np.repeat(part, c))
                size = len(part) * c
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(idx) for i in range(len(carry))],
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(size, model.n, np.int64)),
                        pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), c))),
                        pa.array(model.whiten(run).ravel()),
                        pa.array(np.tile(model.explained, len(part))),
                        pa.array(np.full(size, model.identity_error, np.float64)),
                    ],
                    [*carry, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    if model is None or not len(model.roots):
        return df.sparkSession.createDataFrame([], schema)
    return arrow_map(picked, rows, schema)
