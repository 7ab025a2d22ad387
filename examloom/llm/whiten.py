"""PCA whitening of embeddings with refined eigenvectors.

Components become whole numbers x = floor(scale * c) + shift, so sums and products of centred values are exact and do not
depend on the order in which tasks finish. The fit list holds every distinct x once. One pass sums it per dimension; the
next centres it on the nearest whole mean and sums the products, and the rest of the mean (at most 1/2 per dimension) is
taken off in whole numbers, so the covariance is right to the last place. Only sums per dimension or pair of dimensions
reach the driver: d * (d + 1) / 2 numbers, whatever the number of rows.

Eigenvectors are found in float32 and corrected by the iterations of Ogita and Aishima, which need only products of
matrices, in extended precision. Where eigenvalues lie closer together than the correction can tell, their subspace is
right and only the basis in it is open: the matrix is projected on it, shifted, scaled up and solved in the same way.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite components are
dropped, zero vectors are not; so are vectors with a component beyond 2**40 / scale; null ids and repeated rows stay, and
repeated vectors count once in the fit; a component without variance (its eigenvalue is below d * 2**-50 of the largest)
can't be whitened and is left out; a deviation beyond a long is null; no vector, or only one distinct, gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import share, shared

WIDE = np.longdouble
LARGEST = 1 << 40


class Whitening(NamedTuple):
    n: int  #: distinct vectors
    sums: list[int]  #: per dimension
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: unit eigenvectors, one per column
    trace: float
    error: float  #: largest absolute entry of (covariance of the whitened fit list - identity)


# ---- eigenvectors of a symmetric matrix ----------------------------------------------------------------------------


def refine(a: np.ndarray, x: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correct approximate eigenvectors x of a. Returns vectors, eigenvalues, and which pairs were too close to tell."""
    eps, size = np.finfo(WIDE).eps, np.abs(a).sum(1).max()
    one = np.eye(len(a), dtype=WIDE)
    for _ in range(most):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        lam = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(lam)
        # the 2-norms are bounded by the largest sums of rows
        delta = max(2 * (np.abs(off).sum(1).max() + size * np.abs(r).sum(1).max()), 64 * len(a) * eps * size)
        gap = lam[None, :] - lam[:, None]
        close = np.abs(gap) <= delta
        e = np.where(close, r / 2, (s + lam[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        if np.abs(e).max() <= 1e-10:  # what is left is of the order of its square
            break
    return x, lam, close


def eigen(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    a = np.asarray(a, WIDE)
    d, size = len(a), np.abs(a).max(initial=0)
    if d <= 1 or size == 0:
        return np.diag(a).copy(), np.eye(d, dtype=WIDE)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    for turn in range(4):
        x, lam, close = refine(a, x)
        order = np.argsort(-lam, kind="stable")
        x, lam = x[:, order], lam[order]
        groups = clusters(lam, close[np.ix_(order, order)])
        again = False
        for j in groups if turn < 3 and depth < 6 else []:
            sub = x[:, j]
            t = sub.T @ (a @ sub)
            t = (t + t.T) / 2 - np.eye(len(j), dtype=WIDE) * (np.trace(t) / len(j))
            if np.abs(t).max() > 64 * d * np.finfo(WIDE).eps:  # else equal eigenvalues: any basis will do
                x[:, j] = sub @ eigen(t, depth + 1)[1]
                again = True
        if not again:
            break
    for _ in range(2):
        x = x + x @ (np.eye(d, dtype=WIDE) - x.T @ x) / 2
    lam = (x * (a @ x)).sum(0)
    order = np.argsort(-lam, kind="stable")
    return lam[order] * size, x[:, order]


def clusters(lam: np.ndarray, close: np.ndarray) -> list[list[int]]:
    """Runs of neighbours, in falling order, that are too close to tell."""
    out, run = [], [0]
    for k in range(1, len(lam)):
        if close[k - 1, k]:
            run.append(k)
        else:
            out.append(run)
            run = [k]
    out.append(run)
    return [r for r in out if len(r) > 1]


# ---- exact sums over the fit list ----------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def whole(df: DataFrame, vector: str, scale: int, shift: int, keep: list[str]) -> DataFrame:
    """The columns `keep` and x of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    limit = float(LARGEST) / scale
    inside = lambda c: F.coalesce((c >= -limit) & (c <= limit) & ~F.isnan(c), F.lit(False))
    rows = df.where(F.coalesce(F.forall(v, inside) & (F.size(v) > 0), F.lit(False)))
    size = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    x = F.transform(v, lambda c: F.floor(c * float(scale)) + F.lit(shift))
    return rows.where(F.size(vector) == (size.n if size else 0)).select(*keep, x.alias("x"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sums per dimension."""

    def add(it):
        n, total = 0, None
        for batch in it:
            x = matrix(batch.column(0))
            if len(x):
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    got = rows.select("x").mapInArrow(add, "n long, s array<long>").select("n", F.posexplode("s"))
    got = got.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    return (int(got[0].n), [int(r.s) for r in got]) if got else (0, [])


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y for whole numbers below 2**42 as Python ints, by products of 21-bit parts that doubles hold exactly."""
    base = 1 << 21
    high, low = np.floor_divide(y, base).astype(float), np.mod(y, base).astype(float)
    total = np.zeros((y.shape[1],) * 2, object)
    for k in range(0, len(y), 1024):  # 1024 products below 2**42 stay below 2**53
        h, w = high[k : k + 1024], low[k : k + 1024]
        parts = [w.T @ w] if not h.any() else [w.T @ w, w.T @ h + h.T @ w, h.T @ h]
        for e, p in enumerate(parts):
            total += p.astype(np.int64).astype(object) * base**e
    return total


def moments(rows: DataFrame, middle: list[int]) -> dict[tuple[int, int], int]:
    """Sums of the products of all pairs of dimensions, centred on `middle`."""
    d = len(middle)
    lower = np.tril_indices(d)

    def add(it):
        total = None
        for batch in it:
            x = matrix(batch.column(0))
            if len(x):
                p = products(x - np.array(middle))
                total = p if total is None else total + p
        if total is not None:
            cols = [pa.array(lower[0]), pa.array(lower[1]), pa.array([str(v) for v in total[lower]])]
            yield pa.RecordBatch.from_arrays(cols, ["i", "j", "v"])

    got = rows.select("x").mapInArrow(add, "i long, j long, v string").groupBy("i", "j")
    return {(r.i, r.j): int(r.v) for r in got.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def covariance(n: int, total: list[int], middle: list[int], m: dict[tuple[int, int], int]) -> np.ndarray:
    """From exact sums; each entry is rounded once."""
    g = [s - n * c for s, c in zip(total, middle, strict=True)]
    out = np.zeros((len(g),) * 2, WIDE)
    for (i, j), v in m.items():
        out[i, j] = out[j, i] = WIDE(str(n * v - g[i] * g[j])) / WIDE(str(n * n))
    return out


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n as doubles, without cancelling: whole numbers first, then the rest."""
    middle = [centre(s, n) for s in total]
    rest = np.array([(s - n * c) / n for s, c in zip(total, middle, strict=True)])
    return (x - np.array(middle)).astype(float) - rest


def centre(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


# ---- the operator --------------------------------------------------------------------------------------------------


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors x of `rows`; None where nothing varies."""
    with scratch(rows.sparkSession):
        distinct = materialize(rows.select("x").distinct(), "whiten-fit")
        n, total = sums(distinct)
        if n < 2:
            return None
        middle = [centre(s, n) for s in total]
        values, vectors = eigen(covariance(n, total, middle, moments(distinct, middle)))
        trace = float(values.sum())
        live = int((values > values[0] * len(values) * 2.0**-50).sum()) if values[0] > 0 else 0
        k = min(components, live)
        if not k:
            return None
        model = Whitening(n, total, values[:k].astype(float), vectors[:, :k].astype(float), trace, 0.0)
        return model._replace(error=identity_error(distinct, model))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Measured on the whitened fit list itself, in one more pass."""
    cast = share(distinct.sparkSession, model)

    def add(it):
        m, total, mean = shared(cast), 0.0, 0.0
        for batch in it:
            if len(batch):
                w = whitened(matrix(batch.column(0)), m)
                total, mean = total + w.T @ w, mean + w.sum(0)
        if np.ndim(total):
            k = len(mean)
            cols = [np.repeat(np.arange(k + 1), k), np.tile(np.arange(k), k + 1), np.vstack([total, mean]).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "v"])

    got = distinct.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(model.values)
    out = np.zeros((k + 1, k))
    for r in got:
        out[r.i, r.j] = r.v / model.n
    cast.unpersist()
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """The columns `keep`, the exact deviation and the whitened vector of each row of `whole`'s result."""
    cast = share(rows.sparkSession, model)
    kept = rows.select(*keep).schema

    def apply(it):
        m = shared(cast)
        near = [s - m.n * c for s, c in zip(m.sums, (centre(s, m.n) for s in m.sums), strict=True)]
        middle, near = np.array([centre(s, m.n) for s in m.sums]), np.array(near)
        for batch in it:
            x = matrix(batch.column(batch.num_columns - 1))
            if not len(x):
                continue
            y = x - middle
            # n * x - sums = n * (x - middle) - near
            if (float(m.n) * (float(np.abs(y).max()) + 1)) ** 2 * x.shape[1] < 2.0**62:
                dev = ((m.n * y - near) ** 2).sum(1).tolist()
            else:
                dev = ((m.n * y.astype(object) - near.astype(object)) ** 2).sum(1).tolist()
                dev = [v if v < 1 << 63 else None for v in dev]
            w = whitened(x, m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dev, pa.int64()), lists], [*batch.schema.names[:-1], "deviation", "whitened"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["deviation long", "whitened array<double>"])
    return rows.select(*keep, "x").mapInArrow(apply, schema)


def report(df: DataFrame, ident: str, vector: str, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per remaining row and component."""
    spark = df.sparkSession
    df = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = whole(df, "v", scale, shift, ["vec_id"])
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    share_of = F.array(*(F.lit(float(e) / model.trace) for e in model.values))
    got = transform(rows, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return got.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share_of[F.col("at")].alias("explained"),
        F.lit(model.error).alias("identity_error"),
    )
