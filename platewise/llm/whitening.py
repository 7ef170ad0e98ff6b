"""Embedding whitening by a bidiagonal qd solver.

Rows are whole numbers x, whose sums are exact. Each task reduces its centred rows to a triangle by blockwise QR, and triangles are reduced
by groups of FAN until few are left; the driver holds one d x d triangle R (d: the dimensions of a vector, MOST at most). R is brought to an
upper bidiagonal B = U'RW by Householder reflections, the dqds iteration finds the squares of B's singular values to high relative accuracy, and
twisted factorisations of B'B find the vectors, which the reflections carry back. Two more passes over the rows project them and
measure the covariance of what comes out.

Nulls and edges: rows whose vector is null, is empty, holds a null, a non-finite entry or one beyond 2^52, or is of another length than most
vectors (of equally frequent lengths, the longest) are dropped. An empty table, or one whose rows are all alike, gives no rows: components without variance
(under 1e-12 of the largest) are not numbered. Repeated rows count each and get rows each. A deviation beyond 2^63 is null. Vectors of
more than MOST dimensions are refused with an error. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import saved

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Triangles that are reduced together, rows of a block, dimensions of a vector at most.
FAN, BLOCK, MOST = 16, 4096, 8192
#: Values with less of a gap, relative to the larger, are taken together.
GAP = 1e-5
_EPS = np.finfo(float).eps


# ---- linear algebra on small matrices


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation, d x d (padded with zeros)."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The diagonal and the superdiagonal of B = U'RW, and W, by Householder reflections from both sides."""
    a, d = r.copy(), len(r)
    w = np.eye(d)

    def mirror(x):
        """v and the factor of I - f v v', which brings x to a multiple of the first unit vector."""
        size = np.abs(x).max(initial=0.0)
        if size == 0.0 or not np.any(x[1:]):
            return x, 0.0
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v, 2.0 / (v @ v)

    for k in range(d):
        v, f = mirror(a[k:, k].copy())
        if f:
            a[k:, k:] -= np.outer(f * v, v @ a[k:, k:])
        if k < d - 1:
            v, f = mirror(a[k, k + 1 :].copy())
            if f:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, f * v)
                w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, f * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One step of the differential qd transform with a shift, and the smallest d; None if the shift was past the smallest value."""
    n = len(q)
    hat_q, hat_e = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        hat_q[k] = d + e[k]
        t = q[k + 1] / hat_q[k]
        hat_e[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    if not d >= 0:
        return None
    hat_q[-1] = d
    return hat_q, hat_e, least


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), largest first. Zeros on the diagonal count as eps^2 of the largest entry."""
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    tiny = (_EPS * _EPS * 1e-2) ** 2
    waiting, found = [(np.maximum((a / scale) ** 2, tiny), (b / scale) ** 2, 0.0)], []
    while waiting:
        q, e, moved = waiting.pop()  # values of this part are those of (q, e), plus moved
        least = 0.0
        while len(q) > 1:
            # a negligible entry parts the matrix; the sum beside it is what it is held against
            small = np.flatnonzero(e <= _EPS**2 * np.minimum(q[1:] + moved, q[:-1] + moved))
            if len(small):
                k = small[-1] + 1
                if k == len(q) - 1:
                    found.append(q[-1] + moved)
                else:
                    waiting.append((q[k:], e[k:], moved))
                q, e, least = q[:k], e[: k - 1], 0.0
                continue
            if q[0] < q[-1] and moved == 0.0 and q[0] < 0.25 * q[-1]:
                q, e = _flipped(q, e)
            # the smallest eigenvalue of the last two rows of the qd array is an upper bound that is good near the end
            x, y, z = q[-2] + (e[-2] if len(q) > 2 else 0.0), q[-1] + e[-1], np.sqrt(max(q[-2] * e[-1], 0.0))
            corner = (x + y) / 2 - np.hypot((x - y) / 2, z)
            shift = max(0.0, min(corner, least) * (1 - 1e-6)) if least > 0 else 0.0
            step = None
            while step is None:
                step = _dqds(q, e, shift)
                if step is None:
                    shift = shift * 0.5 if shift > 1e-8 * q[-1] else 0.0
            q, e, least = step
            moved += shift
        if len(q):
            found.append(q[0] + moved)
    return np.sort(np.array(found))[::-1] * scale**2


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bidiagonal read from its other end has the same singular values."""
    return q[::-1].copy(), e[::-1].copy()


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """A vector of B'B for the value: from the top and from the bottom the shifted matrix is factored, and the factors meet where the
    remainder is least."""
    n = len(a)
    guard = _EPS * _EPS * max(float(np.max(a * a)), np.finfo(float).tiny)
    d, lower = a * a, b / np.where(a == 0, np.sqrt(guard), a)[: n - 1]
    s, plus = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        top = s[k] + d[k]
        top = top if abs(top) > guard else guard
        plus[k] = d[k] * lower[k] / top
        s[k + 1] = plus[k] * lower[k] * s[k] - value
    p, minus = np.empty(n), np.empty(n - 1)
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        low = d[k] * lower[k] ** 2 + p[k + 1]
        low = low if abs(low) > guard else guard
        t = d[k] / low
        minus[k] = lower[k] * t
        p[k] = p[k + 1] * t - value
    meet = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[meet] = 1.0
    for k in range(meet - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(meet, n - 1):
        z[k + 1] = -minus[k] * z[k]
    return z / np.linalg.norm(z)


def _parted(a: np.ndarray, b: np.ndarray) -> list[slice]:
    """Where B falls apart into blocks."""
    at = np.flatnonzero(np.abs(b) <= _EPS * np.minimum(np.abs(a[1:]) + np.abs(b), np.abs(a[:-1]) + np.abs(b)) * 1e-2) + 1
    edges = [0, *at.tolist(), len(a)]
    return [slice(i, j) for i, j in zip(edges, edges[1:], strict=False)]


def _together(gram: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors of values that nearly agree, whose twisted vectors need not be orthogonal: steps of inverse iteration, each vector held
    orthogonal to those before it, and a last rotation within their common space."""
    n, scale = len(gram), max(float(np.abs(gram).max()), np.finfo(float).tiny)
    rng, z = np.random.default_rng(n), np.zeros((n, len(values)))
    for k, value in enumerate(values):
        v = rng.standard_normal(n)
        for _ in range(4):
            v = np.linalg.solve(gram - (value - (k + 1) * 4 * _EPS * scale) * np.eye(n), v)
            for _ in range(2):
                v = v / np.linalg.norm(v)
                v = v - z[:, :k] @ (z[:, :k].T @ v)
            v = v / np.linalg.norm(v)
        z[:, k] = v
    return z @ np.linalg.eigh(z.T @ gram @ z)[1][:, ::-1]


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of R'R, largest first, and unit eigenvectors (columns)."""
    a, b, w = bidiagonal(r)
    values, vectors = [], []
    for part in _parted(a, b):
        x, y = a[part], b[part.start : part.stop - 1]
        lam = squares(x, y)
        z = np.zeros((len(a), len(x)))
        gram = np.diag(x * x) + np.diag(np.r_[0.0, y * y]) + np.diag(x[:-1] * y, 1) + np.diag(x[:-1] * y, -1)
        first = 0
        for k in range(1, len(lam) + 1):
            if k < len(lam) and lam[k - 1] - lam[k] <= GAP * lam[k - 1]:
                continue
            z[part, first:k] = _twisted(x, y, lam[first])[:, None] if k == first + 1 else _together(gram, lam[first:k])
            first = k
        values.append(lam)
        vectors.append(z)
    values, vectors = np.concatenate(values), w @ np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---- passes over the rows


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers x of a list column whose lists all have d entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """vec_id, v (array of double) of the rows that are whole, and their length."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x) < 2.0**52)  # noqa: E731  infinity and NaN fail
    whole = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.forall("v", entry) & (F.size("v") > 0))
    lengths = whole.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    got = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    d = got["d"] if got else 0
    if d > MOST:
        raise ValueError(f"vectors of {d} dimensions; {MOST} is the most")
    return whole.where(F.size("v") == d), d


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows, and the exact sum of x in each dimension."""

    def run(batches):
        n, s = 0, np.zeros(d, np.int64)
        for part in _blocks(batches):
            n, s = n + part.num_rows, s + _matrix(part.column("v"), d).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    tasks = rows.select("v").mapInArrow(run, "n bigint, s array<bigint>")
    # a row for each dimension (-1: the number of rows)
    both = tasks.select(F.posexplode(F.concat(F.array("n"), "s")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return (int(both[0]["x"]), np.array([r["x"] for r in both[1:]], np.int64)) if both else (0, np.zeros(d, np.int64))


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S, exact: whole numbers, as Python's where 64 bits might not hold them."""
    wide = int(np.abs(x).max(initial=0)) * n > 2**62 or int(np.abs(s).max(initial=0)) > 2**62
    return x.astype(object) * n - s.astype(object) if wide else x * n - s


def reduced(rows: DataFrame, d: int, n: int, s: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows: in blocks within a task, then by groups of FAN triangles, level by level."""

    def run(batches):
        r = None
        for part in _blocks(batches):
            block = _centred(_matrix(part.column("v"), d), n, s).astype(np.float64) / n
            r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(batches):
        held = None
        for batch in batches:
            for b in batch.column("r"):
                r = np.frombuffer(b.as_py()).reshape(d, d)
                held = r if held is None else triangle(np.vstack([held, r]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    level = saved(rows.select("v").mapInArrow(run, "r binary"), "triangles")
    while (count := level.count()) > FAN:
        level = saved(level.repartition(-(-count // FAN)).mapInArrow(merge, "r binary"), "triangles")
    out = np.zeros((d, d))
    for row in level.toLocalIterator():  # FAN triangles at most
        out = triangle(np.vstack([out, np.frombuffer(bytes(row["r"])).reshape(d, d)]))
    return out


def _projected(d: int, n: int, s: np.ndarray, weights: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    def of(part):
        off = _centred(_matrix(part.column("v"), d), n, s)
        return off, (off.astype(np.float64) / n) @ weights

    return of


def identity_error(rows: DataFrame, d: int, n: int, s: np.ndarray, weights: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened rows, minus the identity."""
    k = weights.shape[1]
    project = _projected(d, n, s, weights)

    def run(batches):
        total = None
        for part in _blocks(batches):
            _, z = project(part)
            z = np.hstack([np.ones((len(z), 1)), z])
            total = z.T @ z + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "x"])

    # (COMPONENTS + 1)^2 sums reach the driver
    got = rows.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros((k + 1, k + 1))
    m[got["i"].to_numpy(), got["j"].to_numpy()] = got["x"].to_numpy()
    mean = m[0, 1:] / n
    cov = np.triu(m[1:, 1:]) / n - np.triu(np.outer(mean, mean))  # means are zero but for rounding
    return float(np.abs(cov - np.eye(k)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    whole, d = usable(rows, vector, key)
    n, s = sums(whole, d) if d else (0, np.zeros(0, np.int64))
    nothing = rows.sparkSession.createDataFrame([], SCHEMA)
    if not n:
        return nothing
    values, vectors = directions(reduced(whole, d, n, s))
    k = min(components, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    if not k:
        return nothing
    e = values / n
    weights = vectors[:, :k] / np.sqrt(e[:k])
    error, share = identity_error(whole, d, n, s, weights), e[:k] / e.sum()
    project = _projected(d, n, s, weights)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for part in _blocks(batches):
            off, z = project(part)
            m = len(z)
            fits = off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * d < 2**62
            deviation = (off * off).sum(axis=1).tolist() if fits else [x if x < 2**63 else None for x in (off.astype(object) ** 2).sum(axis=1)]
            at = np.repeat(np.arange(m), k)
            ids = part.column("vec_id").take(pa.array(at))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return whole.mapInArrow(run, SCHEMA)
