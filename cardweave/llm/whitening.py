"""Whitening by the leading components of the covariance, found by a block Jacobi-Davidson method.

The covariance is never built. The vectors are centred once and written in blocks; a product
of the covariance with a few columns is one distributed pass over the blocks. The driver
holds matrices of the size dimension x (components + search space) only. An outer step
takes Ritz pairs from the search space (Rayleigh-Ritz), locks the leading ones whose residuals have come
down to the rounding of doubles, and widens the space by corrections t with

    (I - QQ') (A - theta I) (I - QQ') t = -r,    Q = locked vectors and the block's Ritz vectors,

solved for all columns of the block at once by a few steps of MINRES.

Defined results: a vector that is null or holds nulls, NaN or infinities is left out, as is an empty one, and one of
another length than the commonest (of equally common ones the longest), which has no covariance with the rest. Equal rows count
as often as they are there. Components whose eigenvalue is zero to rounding cannot be
scaled to one and are left out, so there are at most rank many. An empty table gives an empty result, as do equal vectors alone.
Other columns, whatever their names, are not read. Entries whose integers or squared deviations do not fit a long are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, passing
from cardweave.llm.vectors import add_up, finite, matrix

EPS = np.finfo(np.float64).eps
#: Columns corrected at a time, MINRES steps for each correction, and outer steps before it is an error.
WIDTH, INNER, OUTER = 16, 4, 400
#: Rows of a written block.
ROWS = 2048
LONG = 1 << 63

Product = Callable[[np.ndarray], np.ndarray]


def _orthogonal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to the given orthonormal columns; columns that add nothing go."""
    for _ in range(2):
        for q in against:
            t = t - q @ (q.T @ t)
        size = np.linalg.norm(t, axis=0)
        t = t[:, size > 0] / size[size > 0]
        if not t.shape[1]:
            return t
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-10 * s[0]]
    return t


def minres(apply: Product, rhs: np.ndarray, steps: int, tol: float = 1e-3) -> np.ndarray:
    """Columns of x with apply(x) near rhs, by so many MINRES steps for each column; apply is symmetric and takes all columns at once."""
    x, beta = np.zeros_like(rhs), np.linalg.norm(rhs, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(rhs), rhs / start
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    eta, b = beta.copy(), np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        av = apply(v)
        a = np.einsum("ij,ij->j", v, av)
        av = av - a * v - b * v_old
        b_new = np.linalg.norm(av, axis=0)
        r3, r2 = s_old * b, s * a + c_old * c * b
        r1_hat = c * a - c_old * s * b
        r1 = np.hypot(r1_hat, b_new)
        live &= r1 > 0
        safe = np.where(r1 > 0, r1, 1.0)
        c_old, s_old = c, s
        c, s = r1_hat / safe, b_new / safe
        w_new = (v - r3 * w_old - r2 * w) / safe
        x = x + np.where(live, c * eta, 0.0) * w_new
        w_old, w = w, w_new
        eta = np.where(live, -s * eta, eta)
        live &= (b_new > 1e-14 * start) & (np.abs(eta) > tol * start)
        v_old, v, b = v, av / np.where(b_new > 0, b_new, 1.0), b_new
    return x


def jacobi_davidson(product: Product, dim: int, k: int, width: int = WIDTH, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, largest residual over the first eigenvalue) of the k leading pairs, those above rounding.

    ``product`` is a symmetric positive semi-definite operator of size ``dim``.
    """
    k, width = min(k, dim), min(width, dim)
    most = min(dim, k + 4 * width)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = _orthogonal(np.random.default_rng(1).standard_normal((dim, width)))
    image = product(space)
    for _ in range(OUTER):
        h = space.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        rest = image - space * theta
        rest = rest - locked @ (locked.T @ rest)
        top = max(theta[0] if len(theta) else 0.0, values[0] if len(values) else 0.0)
        if top <= 0:
            return np.zeros(0), np.zeros((dim, 0)), 0.0
        size, tol = np.linalg.norm(rest, axis=0), 4 * np.sqrt(dim) * EPS * top
        whole = space.shape[1] + locked.shape[1] >= dim
        done = 0
        # Only the leading pairs are locked, so that none between them is passed over. A search space
        # as wide as the dimension has no further direction: its pairs are as good as doubles make them.
        while done < len(theta) and (size[done] <= tol or whole and size[done] <= 64 * tol) and locked.shape[1] + done < k:
            done += 1
        locked, values = np.hstack([locked, space[:, :done]]), np.concatenate([values, theta[:done]])
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        if locked.shape[1] >= k:
            break
        if whole and not done:
            raise RuntimeError(f"residuals stay at {size.max() / top:.1e} in a full search space")
        if space.shape[1] + width > most - locked.shape[1] and not whole:
            keep = max(width, most - locked.shape[1] - 2 * width)
            space, image, theta, rest = space[:, :keep], image[:, :keep], theta[:keep], rest[:, :keep]
        width_now = min(width, space.shape[1])
        fixed = np.hstack([locked, space[:, :width_now]])

        def project(t: np.ndarray, q: np.ndarray = fixed) -> np.ndarray:
            return t - q @ (q.T @ t)

        def shifted(t: np.ndarray, at: np.ndarray = theta[:width_now], p: Product = project) -> np.ndarray:
            t = p(t)
            return p(product(t) - t * at)

        if whole:
            continue
        if width_now:
            wider = _orthogonal(project(minres(shifted, -project(rest[:, :width_now]), inner)), locked, space)
        else:
            wider = np.zeros((dim, 0))
        if wider.shape[1] < width:  # an exhausted direction: something new instead
            fresh = np.random.default_rng(2 + locked.shape[1] + space.shape[1]).standard_normal((dim, width - wider.shape[1]))
            wider = np.hstack([wider, _orthogonal(fresh, locked, space, wider)])
        wider = wider[:, : max(0, dim - locked.shape[1] - space.shape[1])]
        space, image = np.hstack([space, wider]), np.hstack([image, product(wider)])
    else:
        raise RuntimeError(f"Jacobi-Davidson did not settle in {OUTER} steps")
    # Locked pairs met at different times: one last Rayleigh-Ritz among them, and their true residuals.
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    h = locked.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = locked @ turn
    worst = np.linalg.norm(image @ turn - vectors * values, axis=0).max() / values[0]
    sure = values > dim * EPS * values[0] * 16
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values[sure], vectors[:, sure], float(worst)


def _integers(vectors: DataFrame, scale: int, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of usable vectors: x = floor(scale * entry) + offset."""
    too_large = F.raise_error(F.lit("an entry is too large for an integer that fits a long"))

    def step(c):
        c = c.cast("double")
        return F.when(F.abs(c) >= F.lit(2.0**52), too_large.cast("long")).otherwise(F.floor(c * F.lit(float(scale))) + F.lit(offset))

    return vectors.filter(finite(vector_col) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.transform(vector_col, step).alias("x"))


class Whitening:
    """What a fit knows: n, the sums S, eigenvalues, components, the trace, and the check of the whitened covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, identity_error: float, residual: float):
        self.n, self.sums, self.values, self.vectors, self.trace, self.identity_error, self.residual = n, sums, values, vectors, trace, identity_error, residual


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: int64 where that is enough, Python's integers beyond."""
    if x.size and n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(points: DataFrame, dim: int, components: int) -> Whitening | None:
    """The whitening of (id, x) rows, all of which have ``dim`` entries."""
    added = points.agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dim))).alias("s")).first()
    n = added["n"]
    if not n:
        return None
    sums = [int(v) for v in added["s"]]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (_centred(matrix(b.column(0), dim), n, sums) / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([z[at : at + ROWS].tobytes() for at in range(0, len(z), ROWS)], pa.binary())], ["z"])

    with passing():
        centred = cut(points.select("x").mapInArrow(blocks, "z binary"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                for z in b.column(0):
                    yield np.frombuffer(z.as_py(), np.float64).reshape(-1, dim)

        def product(y: np.ndarray) -> np.ndarray:
            if not y.shape[1]:
                return y

            def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                out = np.zeros(y.shape)
                for z in each(batches):
                    out += z.T @ (z @ y)
                return out

            return add_up(centred, part) / n

        values, vectors, residual = jacobi_davidson(product, dim, components)
        scaled = vectors / np.sqrt(values)

        def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return np.array([sum(float(np.einsum("ij,ij->", z, z)) for z in each(batches))])

        def totals(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return sum(((z @ scaled).sum(0) for z in each(batches)), np.zeros(len(values)))

        trace, error = float(add_up(centred, squares)[0]) / n, 0.0
        if len(values):
            mean = add_up(centred, totals) / n

            def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                out = np.zeros((len(values), len(values)))
                for z in each(batches):
                    w = z @ scaled - mean
                    out += w.T @ w
                return out

            error = float(np.abs(add_up(centred, spread) / n - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, trace, error, residual)


def whiten(
    vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Whitening | None]:
    """((id, deviation, whitened array) of every usable vector, the fit)."""
    points = _integers(vectors, scale, offset, id_col, vector_col)
    common = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"id {points.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if common is None:
        return points.sparkSession.createDataFrame([], schema), None
    dim = common["d"]
    points = points.filter(F.size("x") == dim)
    fitted = fit(points, dim, components)
    n, sums, scaled = fitted.n, fitted.sums, fitted.vectors / np.sqrt(fitted.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _centred(matrix(b.column(1), dim), n, sums)
            if y.dtype == object or np.abs(y).max(initial=0).astype(float) ** 2 * dim >= LONG:
                far = [sum(int(v) ** 2 for v in r) for r in y]
                if max(far) >= LONG:
                    raise OverflowError("a squared deviation does not fit a long")
            else:
                far = np.einsum("ij,ij->i", y, y)
            w = (y / n).astype(np.float64) @ scaled
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return points.mapInArrow(rows, schema), fitted


def whitening_digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component."""
    out, fitted = whiten(vectors, id_col=id_col, vector_col=vector_col)
    n, explained, error = (fitted.n, fitted.values / fitted.trace if fitted.trace else fitted.values, fitted.identity_error) if fitted else (0, [], 0.0)
    share = F.element_at(F.array(*(F.lit(float(v)) for v in explained)).cast("array<double>"), F.col("component"))
    each = out.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("c", "whitened")).withColumn("component", F.col("c") + 1)
    return each.select(id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
