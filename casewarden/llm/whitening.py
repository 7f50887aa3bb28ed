"""Embedding whitening with weighted multiplicities.

Vectors are put on an integer grid, and identical ones are grouped: from then on every distinct
vector is handled once, with its number of rows (or one, for ``weighted=False``) as its weight in
the fit. Sums are exact integers; the covariance is a weighted product of centred blocks, one
d x d matrix per task, added up by cell. The driver sees d sums, d * d cells and the eigenvectors,
never rows. Each distinct vector is whitened once and joined back to its rows. Vectors that hold
at least a thousandth of all rows (at most 1,000 of them, by count) are joined by broadcast, so
that no task gets all the rows of one; the others meet in a shuffle.

Defined results: a row whose vector is null, empty, or holds null or non-finite entries is dropped;
so is one whose vector is not of the commonest length (of equally common ones the longest);
repeated rows, and repeated or null ids, each get their result; grid entries beyond +-2**62 are set
there; a deviation beyond 38 digits is null; a component without variance (at most d times the
rounding of the trace) has whitened and explained values of 0 and is left out of the identity
error; an empty table gives no rows; other columns are ignored. A component's sign makes its
largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewarden.storage import written

#: Fixed by the contract: grid, offset and number of components.
GRID, OFFSET, COMPONENTS = 64, 1_000_000, 32
HOT = 1000
_FAR = float(1 << 62)
_CELLS = 1 << 20


def on_grid(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, x: vectors of the commonest length with finite entries only."""
    far = F.lit(float("inf"))
    whole = rows.where(F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < far)) & (F.size("embedding") > 0))
    cell = lambda c: F.floor(F.least(F.greatest(c.cast("double") * GRID, F.lit(-_FAR)), F.lit(_FAR))).cast("long") + OFFSET
    length = whole.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    return whole.where(F.size("embedding") == (length["d"] if length else 0)).select("vec_id", F.transform("embedding", cell).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (vectors, weight) of at most ``_CELLS`` entries, with both as arrays."""
    step = max(1, _CELLS // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            yield b, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), b.column(1).to_numpy(zero_copy_only=False)


def _ints(x: np.ndarray, largest: int) -> np.ndarray:
    """x as Python integers if a result as large as ``largest`` would not fit 64 bits."""
    return x if largest < 1 << 62 else x.astype(object)


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def sums(vectors: DataFrame, d: int) -> list[int]:
    """vectors (x, weight): the weighted sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for _, x, w in _blocks(batches, d):
            total += _ints(w, _most(x) * int(w.sum())) @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["i", "s"])

    rows = vectors.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def numerators(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    return _ints(x, 2 * n * (_most(x) + 1) + max(map(abs, s))) * n - np.array(s, object if max(map(abs, s)) >= 1 << 62 else np.int64)


def cross(vectors: DataFrame, d: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """vectors (x, weight): the weighted covariance with divisor n of what ``centred`` makes of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x, w in _blocks(batches, d):
            a = centred(x)
            total += (a * w[:, None].astype(float)).T @ a
        rows = pa.ListArray.from_arrays(pa.array(range(0, d * d + 1, d), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), rows], names=["i", "row"])

    cells = vectors.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / (2 * n)


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns that project and scale, explained shares, and which components have variance."""
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    real = value > trace * len(covariance) * np.finfo(float).eps
    return np.where(real, vector / np.sqrt(np.where(real, value, 1.0)), 0.0), np.where(real, value / (trace or 1.0), 0.0), real


def whiten(rows: DataFrame, k: int = COMPONENTS, weighted: bool = True) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, n, deviation decimal(38,0), whitened, explained (arrays by component), identity_error."""
    each = on_grid(rows.select("vec_id", "embedding"))
    groups = written(each.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    weight = F.col("copies") if weighted else F.lit(1).cast("long")
    fit = groups.select("x", weight.alias("weight"))
    n, d = fit.agg(F.sum("weight"), F.max(F.size("x"))).first()
    if not n:
        none = "array<double>"
        return each.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast(none).alias("whitened"), F.array().cast(none).alias("explained"), F.lit(0.0).alias("identity_error"))
    s = sums(fit, d)
    scale, explained, real = components(cross(fit, d, n, lambda x: (numerators(x, n, s) / n).astype(float)), min(k, d))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, _ in _blocks(batches, d):
            exact = numerators(x, n, s)
            w = (exact / n).astype(float) @ scale
            squares = (_ints(exact, d * _most(exact) ** 2) ** 2).sum(axis=1)
            if squares.dtype == object:
                deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            else:
                deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(range(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), deviation, lists], names=["x", "weight", "copies", "deviation", "whitened"])

    shown = "x array<long>, weight long, copies long, deviation decimal(38,0), whitened array<double>"
    white = written(groups.select("x", weight.alias("weight"), "copies").mapInArrow(project, shown), "white")
    r = len(explained)
    mean = white.select("weight", F.posexplode("whitened").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v") * F.col("weight")).alias("s")).collect()
    mean = np.array([m["s"] / n for m in sorted(mean, key=lambda m: m["i"])])
    identity = cross(white.select("whitened", "weight"), r, n, lambda w: w - mean) - np.eye(r)
    error = float(np.abs(identity[np.ix_(real, real)]).max()) if real.any() else 0.0

    often = F.col("copies") * HOT >= F.lit(groups.agg(F.sum("copies")).first()[0])
    hot = F.broadcast(white.where(often).select("x", "deviation", "whitened"))
    rest = each.join(hot.select("x"), "x", "left_anti").join(white.where(~often).select("x", "deviation", "whitened"), "x")
    back = each.join(hot, "x").unionByName(rest)
    return back.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(float(e)) for e in explained]).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.select("vec_id", F.posexplode("whitened").alias("i", "whitened"), "n", "deviation", "explained", "identity_error")
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get("explained", F.col("i")).alias("explained"), "identity_error",
    )
