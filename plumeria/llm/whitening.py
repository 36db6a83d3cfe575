"""Embedding whitening by polarisation covariance.

Vectors are put on a grid: each entry c becomes the integer floor(256 * c). The covariance is that of the
fit list, which has each distinct grid vector once. With n vectors and the sums S, the centred value
n * x - S is an integer too, and for every dimension i and every pair of dimensions the fit sums the exact squares

    Q(i) = sum (n * x_i - S_i)^2            Q(i, j) = sum ((n * x_i - S_i) + (n * x_j - S_j))^2

so that cov(i, j) = (Q(i, j) - Q(i) - Q(j)) / (2 * n^3): a difference of variances, rounded once. Only these
d * (d + 1) / 2 sums come to the driver, which assembles the matrix for ``eigh``; neither their
number nor its memory depends on the rows. Squares are summed in limbs of 21 bits and sent as parts of 32
bits, so no count of rows overflows them; values too large for 64 bits are summed as Python integers.

Scale: the distinct vectors are the one shuffle of vectors (combined before it, so a vector that a third of the rows hold is
no hot key); they are written down, as three passes read them. All sums are combined in the tasks.

Nulls: rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are those of another
length than most distinct vectors have (of equally frequent lengths the longer). Ids play no part: null and
repeated ones keep a row each. Components without variance (as with one distinct vector, or more
components than the rank) are null, and so is the error where none has any. An empty table gives no rows. A deviation
of more than 38 digits is null. The functions give columns, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import saved, ship

STEP = 256
#: Bits of a limb; sums of products of limbs over 2^20 rows stay within 62 bits.
LIMB = 21
#: Entries of the vectors that are summed at a time.
TOGETHER = 1 << 20


def grid(vector: Column) -> Column:
    """The vector as integers. Entries beyond 64 bits are held at their end."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * STEP))


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, NaN or infinite."""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))


def square_sums(e: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each column, as Python integers. Columns: int64 of at most 2^20 rows, or objects."""
    if e.dtype == object:
        return (e * e).sum(axis=0)
    limbs, rest = [], e
    while len(rest) and max(int(rest.max(initial=0)), -int(rest.min(initial=0))) >= 1 << LIMB:
        limbs.append(rest & ((1 << LIMB) - 1))
        rest = rest >> LIMB
    limbs.append(rest)
    total = np.zeros(e.shape[1], object)
    for a in range(len(limbs)):
        for b in range(a, len(limbs)):
            total += np.einsum("ij,ij->j", limbs[a], limbs[b]).astype(object) * ((1 + (a != b)) << (LIMB * (a + b)))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as int64 where the sum of two such values is sure to fit, else as Python integers."""
    most = max([1, int(x.max(initial=0)), -int(x.min(initial=0)), *(-(-abs(s) // n) for s in sums)])
    if n * most < 1 << 60:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def pair_square_sums(e: np.ndarray) -> np.ndarray:
    """Q(i) of every dimension, then Q(i, j) of the pairs (0, 1), (0, 2), ..., (1, 2), ..."""
    d = e.shape[1]
    return np.concatenate([square_sums(e), *(square_sums(e[:, i : i + 1] + e[:, i + 1 :]) for i in range(d - 1))])


def _matrix(vectors: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The sums over all rows of what ``of`` gives for a matrix of some of them."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            x = _matrix(b.column(0), d)
            for i in range(0, len(x), max(1, TOGETHER // d)):
                total = total + of(x[i : i + max(1, TOGETHER // d)])
        if isinstance(total, int):
            return
        rows = []
        for k, v in enumerate(total):
            v, p = int(v), 0
            while not -(1 << 31) <= v < 1 << 31:
                rows.append((k, p, v & 0xFFFFFFFF))
                v, p = v >> 32, p + 1
            rows.append((k, p, v))
        k, p, v = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int32()), pa.array(v, pa.int64())], ["k", "part", "v"])

    out: dict[int, int] = {}
    for r in fit.select("x").mapInArrow(parts, "k long, part int, v long").groupBy("k", "part").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["k"]] = out.get(r["k"], 0) + (r["v"] << (32 * r["part"]))
    return [out[k] for k in range(len(out))]


def covariance(squares: list[int], n: int, d: int) -> np.ndarray:
    """The covariance matrix (divisor n) from :func:`pair_square_sums`."""
    v, k = np.zeros((d, d)), d
    for i in range(d):
        v[i, i] = squares[i] / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (squares[k] - squares[i] - squares[j]) / (2 * n**3)
            k += 1
    return v


@dataclass
class Whitening:
    """n vectors with sums; the first components (columns of ``vectors``) with their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def full(self) -> int:
        """Components with variance; they come first."""
        return int((self.values > 0).sum())


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """The whitening of df's vectors; None where no vector is usable."""
    ship(df.sparkSession)
    rows = saved(df.where(usable(F.col(vector))).select(grid(F.col(vector)).alias("x")).where("size(x) > 0").distinct(), "whitening")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("x") == d)
    sums = exact_sums(rows, d, lambda x: np.array([int(hi) * 2**32 + int(lo) for hi, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))], object))
    v = covariance(exact_sums(rows, d, lambda x: pair_square_sums(centred(x, n, sums))), n, d)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    e = np.where(e > d * np.finfo(float).eps * max(float(e[0]), 0.0), e, 0.0)
    trace = float(np.trace(v))
    model = Whitening(n, sums, e, np.ascontiguousarray(u), [float(x) / trace if trace > 0 else None for x in e])
    if k := model.full:
        w = rows.select(_apply(model, F.col("x"))["whitened"].alias("w"))
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        found = w.select(*(F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
        model.identity_error = max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))
    return model


def _apply(model: Whitening, x: Column) -> Column:
    n, sums, k = model.n, model.sums, model.full
    scaled = model.vectors[:, :k] / np.sqrt(model.values[:k])
    absent = [None] * (len(model.values) - k)

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def applied(vectors: pd.Series) -> pd.DataFrame:
        deviation, out = [None] * len(vectors), [None] * len(vectors)
        there = np.flatnonzero([v is not None and len(v) == len(sums) for v in vectors])
        for at in np.split(there, range(4096, len(there), 4096)):
            if not len(at):
                continue
            e = centred(np.stack([vectors.iloc[i] for i in at]).astype(np.int64), n, sums)
            w = (e / n).astype(float) @ scaled
            wide = e.dtype == object or len(sums) * int(np.abs(e).max()) ** 2 >= 1 << 63
            squares = (e.astype(object) ** 2 if wide else e * e).sum(axis=1)
            for i, s, row in zip(at, squares.tolist(), w.tolist()):
                deviation[i], out[i] = Decimal(s) if s < 10**38 else None, row + absent
        return pd.DataFrame({"deviation": pd.Series(deviation, dtype=object), "whitened": pd.Series(out, dtype=object)})

    return applied(x)


def fits(model: Whitening, vector: Column) -> Column:
    """Whether the model whitens the vector."""
    return usable(vector) & (F.size(vector) == len(model.sums))


def whitened(model: Whitening, vector: Column) -> Column:
    """A struct of ``deviation`` (the sum over dimensions of (n * x - S)^2) and ``whitened`` (a value for each component); nulls where it does not fit."""
    return _apply(model, F.when(fits(model, vector), grid(vector)))


def components(model: Whitening) -> Column:
    """The components as an array of structs: component, explained."""
    return F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(x).cast("double").alias("explained")) for i, x in enumerate(model.explained)))
