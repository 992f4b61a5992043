"""Embedding whitening by incremental eigendecomposition.

Vectors become fixed-point numbers, x = floor(SCALE * entry), and the fit list is
every distinct x once. Each partition of the fit list keeps the eigenvalues and
eigenvectors of its centred scatter and takes its rows in one by one: a further
row is a rank-one update, whose new eigenvalues are the roots of a secular
equation, one between any two old ones, after deflation of what the update doesn't
touch (equal eigenvalues are turned so that one vector meets the row; directions
that the row doesn't reach stay). Two spectra are combined by as many such updates,
one per eigenpair of the second and one for the shift of the means, in a tree of
groups of FANOUT. The leading vectors then start a Rayleigh-Ritz refinement: each
pass multiplies the basis by the covariance, summed over all partitions, solves the
small projected problem and adds the residuals to the basis, until these stop
falling; so rounding in the updates leaves no trace in the result.

A task holds one spectrum, whatever the number of rows, and the driver one spectrum
and a basis of a few vectors: both grow with the square of the dimension only.

Results for special rows: rows whose vector is null, empty, or holds a null or
non-finite entry are dropped; so are rows of another dimension than the most
frequent one (of several, the largest). A null or repeated ``vec_id`` is passed
through, each row on its own; other columns are left out. Components with no
variance to speak of (under 1e-12 of the trace) have no whitened direction and no
rows, so one distinct vector, or an empty table, gives none. ``deviation`` is exact,
and null where it passes 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

SCALE = 256
COMPONENTS = 4
# Further vectors in the basis, which let the refinement converge where eigenvalues are close.
SPARE = 4
ROWS_PER_TASK = 4096
# Spectra or sums that one task combines.
FANOUT = 32
MOST_PASSES = 30
EPS = float(np.finfo(np.float64).eps)


def secular_roots(poles: np.ndarray, z2: np.ndarray, inverse_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``inverse_weight + sum(z2 / (pole - mu)) = 0`` for ascending distinct poles and positive z2.

    Root j lies between poles j and j + 1, the last one above all. Returned are all
    differences pole_i - root_j, and the roots; a root is kept as its distance from
    the nearer pole, so that these differences are accurate.
    """
    k = len(poles)
    cols = np.arange(k)
    gap = np.append(np.diff(poles), z2.sum() / inverse_weight)
    half = gap / 2
    weights = z2[:, None]
    f = inverse_weight + (weights / (poles[:, None] - poles - half)).sum(0)
    right = f < 0
    right[-1] = False
    origin = cols + right
    delta = poles[:, None] - poles[origin]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    if f[-1] < 0:
        low[-1], high[-1] = half[-1], gap[-1] * (1 + 4 * EPS)
    tau = (low + high) / 2
    upto = (cols[:, None] <= cols).astype(float)
    after = np.minimum(cols + 1, k - 1)
    done = np.zeros(k, dtype=bool)
    for _ in range(80):
        diff = delta - tau
        part = weights / diff
        below, every = np.einsum("ij,ij->j", part, upto), part.sum(0)  # the first are all negative, the others positive
        f = inverse_weight + every
        done |= np.abs(f) <= 8 * EPS * (inverse_weight + every - 2 * below)
        high, low = np.where(f > 0, tau, high), np.where(f < 0, tau, low)
        done |= high - low <= 2 * EPS * np.abs(tau)
        if done.all():
            break
        slope = part / diff
        left = np.einsum("ij,ij->j", slope, upto)
        total = slope.sum(0)
        one, two = diff[cols, cols], diff[after, cols]
        # the two nearest poles, each with the weight that fits the slope on its side
        with np.errstate(all="ignore"):
            c = f - one * left - two * (total - left)
            a = (one + two) * f - one * two * total
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + total[-1] * one[-1] ** 2 / (f[-1] - total[-1] * one[-1])
        new = tau + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        tau = np.where(done, tau, new)
    return delta - tau, poles[origin] + tau


def rank_one_update(values: np.ndarray, vectors: np.ndarray, step: np.ndarray, weight: float):
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + weight step step'``."""
    z = step @ vectors
    size = float(z @ z)
    if weight * size <= 0.0:
        return values, vectors
    tiny = 8 * EPS * max(values[-1], weight * size)
    near = np.diff(values) <= tiny
    if near.any():  # equal eigenvalues: one vector of each group takes the whole of z there
        vectors = vectors.copy()
        bounds = np.flatnonzero(np.concatenate([[True], ~near, [True]]))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo > 1:
                mirror = z[lo:hi].copy()
                length = np.sqrt(mirror @ mirror)
                if length == 0.0:
                    continue
                sign = 1.0 if mirror[-1] >= 0 else -1.0
                mirror[-1] += sign * length
                vectors[:, lo:hi] -= np.outer(vectors[:, lo:hi] @ mirror, mirror * (2 / (mirror @ mirror)))
                z[lo:hi] = 0.0
                z[hi - 1] = -sign * length
    live = np.flatnonzero(weight * np.sqrt(size) * np.abs(z) > tiny)
    if not len(live):
        return values, vectors
    poles, part = values[live], z[live]
    diff, roots = secular_roots(poles, part * part, 1 / weight)
    # z anew from the roots, so that the vectors below are orthogonal to rounding
    ratio = poles - poles[:, None]
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.abs(np.prod(-diff / ratio, axis=1) / weight)) * np.sign(part)
    turn = exact[:, None] / diff
    turn /= np.sqrt((turn * turn).sum(0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[live] = roots
    out_vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


class Spectrum:
    """Number of rows, their mean, and the eigenpairs of their scatter about it."""

    def __init__(self, dim: int):
        self.n, self.mean = 0.0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, row: np.ndarray) -> None:
        step = row - self.mean
        self.n += 1
        if self.n > 1:
            self.values, self.vectors = rank_one_update(self.values, self.vectors, step, (self.n - 1) / self.n)
        self.mean = self.mean + step / self.n

    def absorb(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one_update(self.values, self.vectors, vector, value)
        step, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one_update(self.values, self.vectors, step, self.n * other.n / n)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @staticmethod
    def unpack(raw: bytes, dim: int) -> Spectrum:
        x, out = np.frombuffer(raw), Spectrum(dim)
        out.n, out.mean, out.values = float(x[0]), x[1:dim + 1].copy(), x[dim + 1:2 * dim + 1].copy()
        out.vectors = x[2 * dim + 1:].reshape(dim, dim).copy()
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable_rows(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vectors have finite entries only."""
    good = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _part() -> int:
    return TaskContext.get().partitionId()


def _fold(rows: DataFrame, parts: int, merge, name: str | None = None) -> bytes:
    """The payloads of ``rows`` (part, payload), parts 0 to ``parts`` - 1, merged in groups of FANOUT until one is left."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        payloads = table.column("payload").take(pa.array(order)).to_pylist()
        part = table.column("part")[0].as_py() // FANOUT
        return pa.table({"part": pa.array([part], pa.int64()), "payload": pa.array([merge(payloads)], pa.binary())})

    while parts > 1:
        rows = rows.groupBy(F.floor(F.col("part") / FANOUT).alias("group")).applyInArrow(run, "part long, payload binary")
        if name:
            rows = stored(rows, name)
        parts = -(-parts // FANOUT)
    return bytes(rows.first()["payload"])


def spectra(fit: DataFrame, dim: int) -> DataFrame:
    """Per partition of ``fit`` (x): (part, payload of its spectrum, n, sums per dimension as exact decimals)."""

    def run(batches):
        spectrum, n, sums = Spectrum(dim), 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            if len(x) and int(np.abs(x).max()) * len(x) < 2**62:
                sums = [s + int(t) for s, t in zip(sums, x.sum(0))]
            else:
                sums = [s + sum(column) for s, column in zip(sums, x.T.tolist())]
            for row in x.astype(np.float64):
                spectrum.add(row)
        if n:
            yield pa.record_batch(
                [pa.array([_part()], pa.int64()), pa.array([spectrum.pack()], pa.binary()), pa.array([n], pa.int64()),
                 pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["part", "payload", "n", "sums"])

    return fit.mapInArrow(run, "part long, payload binary, n long, sums array<string>")


def _sum_payloads(payloads: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p) for p in payloads], axis=0).tobytes()


def _gathered(fit: DataFrame, dim: int, centre: np.ndarray, of_rows) -> np.ndarray:
    """The sum over all rows of ``of_rows``, which gives a flat array for a matrix of centred rows."""

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if len(x):
                got = of_rows(x - centre)
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([_part()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                  names=["part", "payload"])

    parts = fit.rdd.getNumPartitions()  # of the scan; nothing runs
    return np.frombuffer(_fold(fit.mapInArrow(run, "part long, payload binary"), parts, _sum_payloads))


def refine(multiply, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and unit eigenvectors by Rayleigh-Ritz passes.

    ``multiply(Q)`` is the covariance times Q. Residuals join the basis until they stop falling.
    """
    keep, best, found = basis.shape[1], np.inf, None
    for _ in range(MOST_PASSES):
        basis = np.linalg.qr(basis)[0]
        image = multiply(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        ritz = basis @ turn
        residual = image @ turn - ritz * values
        worst = float(np.sqrt((residual[:, :wanted] ** 2).sum(0)).max(initial=0.0))
        if worst < best:
            found = values[:wanted], ritz[:, :wanted]
        if basis.shape[1] == len(basis) or worst <= EPS * abs(values[0]) or worst > 0.5 * best and worst <= 1e-10 * abs(values[0]):
            break
        best = min(best, worst)
        # what the residuals add to the kept vectors, orthogonal to them before QR so that rounding doesn't rule
        ritz = ritz[:, :keep]
        more = residual[:, :wanted] / np.maximum(np.sqrt((residual[:, :wanted] ** 2).sum(0)), 1e-300)
        more = more - ritz @ (ritz.T @ more)
        basis = np.concatenate([ritz, more], axis=1)[:, :len(basis)]
    return found


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``n``: vectors of the fit list. ``deviation``: the sum over dimensions of (n x - S)**2, S the fit list's sums.
    ``whitened``: the centred x on the component's unit eigenvector, over the root of its eigenvalue.
    ``explained``: the eigenvalue's share of the trace. ``identity_error``: the largest entry, over the fit list, of the
    whitened columns' covariance less the identity.
    """
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    spark = rows.sparkSession
    usable = stored(usable_rows(rows, id_column, vector_column, scale), "whitening-rows")
    common = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    usable = usable.filter(F.size("x") == dim)
    fit = stored(usable.select("x").distinct(), "whitening-fit")
    parts = -(-fit.count() // ROWS_PER_TASK)

    local = stored(spectra(fit.repartition(parts, "x"), dim), "whitening-spectra")
    n = local.agg(F.sum("n")).first()[0]
    per_dim = local.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")))
    sums = [int(s) for _, s in sorted(per_dim.collect())]  # one row per dimension
    centre = np.array([s / n for s in sums])

    def combine(payloads: list[bytes]) -> bytes:
        first, *others = (Spectrum.unpack(p, dim) for p in payloads)
        for other in others:
            first.absorb(other)
        return first.pack()

    whole = Spectrum.unpack(_fold(local.select("part", "payload"), parts, combine, "whitening-merged"), dim)
    wanted = min(components, dim)
    traces = []

    def multiply(basis: np.ndarray) -> np.ndarray:
        got = _gathered(fit, dim, centre, lambda x: np.append((x.T @ (x @ basis)).ravel(), (x * x).sum()))
        traces.append(got[-1] / n)
        return got[:-1].reshape(dim, -1) / n

    values, vectors = refine(multiply, whole.vectors[:, ::-1][:, :min(dim, wanted + SPARE)], wanted)
    trace = traces[-1]
    good = int((values > 1e-12 * trace).sum()) if trace > 0 else 0
    if not good:
        return spark.createDataFrame([], schema)
    values, vectors = values[:good], vectors[:, :good] / np.sqrt(values[:good])

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ vectors
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = _gathered(fit, dim, centre, moments) / n
    error = float(np.abs(got[good:].reshape(good, good) - np.outer(got[:good], got[:good]) - np.eye(good)).max())
    explained = values / trace

    def run(batches):
        total = np.array(sums, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
            if reach * reach * dim < 2**63:
                far = x * n - total.astype(np.int64)
                deviation = pa.array((far * far).sum(1), pa.int64())
            else:
                far = ((x.astype(object) * n - total) ** 2).sum(1)
                deviation = pa.array([d if d < 2**63 else None for d in far], pa.int64())
            again = pa.array(np.repeat(np.arange(len(x)), good))
            whitened = ((x - centre) @ vectors).ravel()
            yield pa.record_batch(
                [batch.column(0).take(again), pa.array(np.tile(np.arange(1, good + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(again), n), pa.int64()), deviation.take(again), pa.array(whitened),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, schema)
