"""Embedding whitening: a compensated covariance over the cluster, then its eigenvectors.

Every entry c becomes the whole number x = floor(scale * c) + offset, whose large mean a plain
sum of squares would cancel against. The covariance is over the fit list, each distinct
x-vector once, and is centred before anything is multiplied: exact sums give the mean as a
double-double (hi + lo), x - mean is one too. Each centred column is cut into slices of SLICE
bits over a power of two of its own; the products of two slices, summed over a block of at most
BLOCK rows, are whole numbers below 2^53, so a matrix product makes them without any rounding.
These blocks are added up in double-double (two-sum keeps what a plain sum would lose), and
tasks hand on high and low parts, which are merged in task order, a matrix row a group.

The eigen-solve is LAPACK's tridiagonal divide and conquer (numpy's eigh); its vectors are then
made exact to double precision by few rotations in extended precision, low parts included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Larger entries are held here, so that x is exact in double precision.
LARGEST = 2**52
BLOCK, SLICE, SLICES = 1024, 20, 6
#: An eigenvalue below this share of the greatest is zero at double precision: it has no component.
RANK = 2.0**-46
_LOW = 26  # bits of the low half in which sums of x are made

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as rounded, and exactly what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def ratio(top: list[int], n: int) -> Pair:
    """top / n of whole numbers as double-doubles."""
    hi = [t / n for t in top]  # Python divides whole numbers with one rounding
    lo = []
    for t, h in zip(top, hi, strict=True):
        a, b = h.as_integer_ratio()
        lo.append((t * b - a * n) / (n * b))
    return np.array(hi), np.array(lo)


def centred(x: np.ndarray, mean: Pair) -> Pair:
    s, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(s, e - mean[1])


def outer_sum(c: Pair) -> Pair:
    """Sum of the outer products of the rows of hi + lo (at most BLOCK of them) as a double-double matrix."""
    rest, low = c[0].copy(), c[1]
    top = np.abs(rest).max(0, initial=0.0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))))
    parts = []
    for k in range(SLICES):
        unit = unit * 2.0**-SLICE
        q = np.rint(rest / unit)
        rest = rest - q * unit
        if k == 2:  # what is left of hi is now small enough to take lo in
            rest = rest + low
        parts.append((q, unit))
    total = (np.zeros((len(top), len(top))),) * 2
    for i, (a, u) in enumerate(parts):
        for j, (b, v) in enumerate(parts[i:], i):
            if i + j >= SLICES:  # below what a double-double holds
                continue
            exact = (a.T @ b) * u[:, None] * v[None, :]
            total = dd_add(total, (exact, np.zeros_like(exact)))
            if i != j:
                total = dd_add(total, (exact.T, np.zeros_like(exact)))
    return total


def spectrum(cov: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric double-double matrix."""
    _, x = np.linalg.eigh(cov[0] + cov[1])
    a, x = cov[0].astype(np.longdouble) + cov[1], x.astype(np.longdouble)
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=np.longdouble) - x.T @ x) / 2
    b = x.T @ a @ x
    least = np.abs(np.diag(b)).max(initial=0) * 2.0**-63
    for _ in range(4):  # what eigh left off the diagonal goes by rotations, which close eigenvalues do not hinder
        left = np.argwhere(np.triu(np.abs(b) > least, 1))
        if not len(left):
            break
        for i, j in left:
            if abs(b[i, j]) <= least:
                continue
            t = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
            c = 1 / np.sqrt(t * t + 1)
            turn = np.array([[c, t * c], [-t * c, c]], np.longdouble)
            at = [i, j]
            b[:, at] = b[:, at] @ turn
            b[at] = turn.T @ b[at]
            x[:, at] = x[:, at] @ turn
    values = np.diag(b)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order].astype(np.float64), (x / np.sqrt((x * x).sum(0))).astype(np.float64)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, matrix) of a column of whole-number vectors, for every length that occurs."""
    starts = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values), np.diff(starts)
    for d in np.unique(sizes):
        if d:
            rows = np.flatnonzero(sizes == d)
            yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, length and dimension: rows, and the sums of high and low halves of x (both exact)."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _by_length(b.column(0)):
            here = np.stack([np.full(d, len(x)), (x >> _LOW).sum(0), (x & ((1 << _LOW) - 1)).sum(0)])
            found[d] = found.get(d, 0) + here
    for d, (n, hi, lo) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(n), pa.array(hi), pa.array(lo)], ["d", "i", "n", "hi", "lo"])


def _means(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: n and the exact sum of every dimension. A row a dimension reaches the driver."""
    whole = "decimal(38,0)"
    per = fit.mapInArrow(_sums, "d long, i long, n long, hi long, lo long").groupBy("d", "i")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in per.agg(F.sum(F.col("n").cast(whole)).alias("n"), F.sum(F.col("hi").cast(whole)).alias("hi"), F.sum(F.col("lo").cast(whole)).alias("lo")).collect():
        out.setdefault(r.d, (int(r.n), [0] * r.d))[1][r.i] = (int(r.hi) << _LOW) + int(r.lo)
    return out


def _outer(fit: DataFrame, rows_of) -> dict[int, Pair]:
    """Per length: the sum of outer products of rows_of(length, x), a double-double matrix, over the fit list."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for b in batches:
            for d, _, x in _by_length(b.column(0)):
                for at in range(0, len(x), BLOCK):
                    here = outer_sum(rows_of(d, x[at : at + BLOCK]))
                    found[d] = dd_add(found[d], here) if d in found else here
        part = TaskContext.get().partitionId()
        for d, (hi, lo) in found.items():
            k = len(hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([part] * k, pa.int64()), pa.array([r.tobytes() for r in hi]), pa.array([r.tobytes() for r in lo])],
                ["d", "i", "part", "hi", "lo"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([total[0].tobytes()]), pa.array([total[1].tobytes()])], ["d", "i", "hi", "lo"])

        for b in batches:
            for d, i, hi, lo in zip(*(b.column(c).to_pylist() for c in ("d", "i", "hi", "lo")), strict=True):
                here = np.frombuffer(hi), np.frombuffer(lo)
                if key == (d, i):
                    total = dd_add(total, here)
                else:
                    if key is not None:
                        yield done()
                    key, total = (d, i), here
        if key is not None:
            yield done()

    parts = fit.mapInArrow(gather, "d long, i long, part long, hi binary, lo binary")
    merged = parts.repartition("d", "i").sortWithinPartitions("d", "i", "part").mapInArrow(merge, "d long, i long, hi binary, lo binary")
    rows: dict[int, dict[int, Pair]] = {}
    for r in merged.collect():
        rows.setdefault(r.d, {})[r.i] = np.frombuffer(r.hi), np.frombuffer(r.lo)
    return {d: tuple(np.stack([m[i][h] for i in range(len(m))]) for h in (0, 1)) for d, m in rows.items()}


def _scaled(total: Pair, n: int) -> Pair:
    """total / n as double-double."""
    hi = total[0] / n
    back = hi.astype(np.longdouble) * n
    return two_sum(hi, ((total[0].astype(np.longdouble) - back) / n).astype(np.float64) + total[1] / n)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 of each row, exactly; null where it passes a long."""
    largest = max(1, int(np.abs(x).max(initial=0)), max(map(abs, sums)) // n + 1)
    if 2 * n * largest < 2**62:
        off = n * x - np.array(sums, np.int64)
        most = int(np.abs(off).max(initial=0))
        if most * most * x.shape[1] < 2**63:
            return (off * off).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Per vector and component (at most `components`): id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out; entries beyond
    +-2^52 / scale are held there. Vectors of different lengths are different spaces, each fitted
    by itself; an empty vector has no component and gives no row. Equal vectors count once in
    the fit and each gets its rows; null ids stay null. Components are numbered by falling
    eigenvalue, ties in any order; directions without variance (below 2^-46 of the greatest
    eigenvalue) have none, so equal vectors alone, or a single one, give no rows, and neither
    does an empty table. deviation is null where it passes a long. Other columns are not read.
    The driver holds a matrix a length, of its dimensions alone.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(held(c)).cast("long") + offset).alias("x"))
    fit = scratch.put(rows.select("x").distinct(), "fit")
    means = _means(fit)
    mean = {d: ratio(s, n) for d, (n, s) in means.items()}
    covs = _outer(fit, lambda d, x: centred(x, mean[d]))
    maps, shares, errors = {}, {}, {}
    for d, total in covs.items():
        cov = _scaled(total, means[d][0])
        values, vecs = spectrum(cov)
        k = int((values[:components] > max(values[0], 0) * RANK).sum())
        trace = float(np.diag(cov[0]).astype(np.longdouble).sum() + np.diag(cov[1]).sum())
        maps[d] = vecs[:, :k] / np.sqrt(values[:k])
        shares[d] = values[:k] / trace if k else values[:0]

    def white(d: int, x: np.ndarray) -> np.ndarray:
        hi, lo = centred(x, mean[d])
        return hi @ maps[d] + lo @ maps[d]

    for d, total in _outer(fit, lambda d, x: (white(d, x), np.zeros((len(x), maps[d].shape[1])))).items():
        errors[d] = float(np.abs(_scaled(total, means[d][0])[0] - np.eye(len(total[0]))).max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                for d, here, x in _by_length(b.column(1)):
                    n, sums = means[d]
                    k = maps[d].shape[1]
                    each = np.repeat(np.arange(len(here)), k)
                    wide = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(here[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(here))), pa.array(np.full(len(each), n)), wide,
                         pa.array(white(d, x).ravel()), pa.array(np.tile(shares[d], len(here))), pa.array(np.full(len(each), errors.get(d, 0.0)))],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    scratch.drop("fit")
    return rows.mapInArrow(project, f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
