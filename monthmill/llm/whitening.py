"""Embedding whitening from exact moments by bit slices.

Components become integers, and each distinct integer vector counts once.  A task packs
every dimension's bit planes, shifted so that no value is negative, over its rows into
64-bit words: the number of common bits of two planes, times the planes' weights, summed over all
pairs of planes of two dimensions, is their exact cross-product.  A further dimension of ones gives sums
and the count in the same way.  Products are kept in limbs of 30 bits, so adding
them up neither rounds nor overflows.  Centring is done on the integers, n * products less
sums times sums, which no shift changes; only then do numbers become floating, for ``eigh``.

Vectors of one length are a fit of their own.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table
from .embedding_dedup import by_length

SCALE, COMPONENTS = 256, 4
LIMB = 30
#: Bytes of bit planes that a task holds at once.
PLANES = 16 << 20
#: Numbers of models that are sent to the tasks at once; more go in several rounds of lengths.
MODEL_NUMBERS = 4_000_000


def steps(vector: Column) -> Column:
    """floor(SCALE * component) as long; null for a vector that is null or empty, or holds null, non-finite or, times SCALE, numbers from 2^62 on."""
    v = vector.cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(2**62 // SCALE)), F.lit(False)))
    return F.when(fits & (F.size(v) > 0), F.transform(v, lambda c: F.floor(c * SCALE)))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def cross_products(shifted: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """By limb k: int64 matrices D with sum over k of 2^(LIMB k) D = the products of the columns of (``shifted``, ones), upper half.

    ``shifted``: non-negative integers of up to ``bits`` bits.
    """
    rows, dim = shifted.shape
    own = np.concatenate([np.repeat(np.arange(dim), bits), [dim]])
    bit = np.concatenate([np.tile(np.arange(bits), dim), [0]])
    total: dict[int, np.ndarray] = {}
    chunk = max(64, PLANES * 8 // len(own) // 64 * 64)
    for start in range(0, rows, chunk):
        u = shifted[start : start + chunk]
        length = -(-len(u) // 64) * 8
        planes = np.zeros((len(own), length), np.uint8)
        for b in range(bits):
            held = np.packbits((u >> b).astype(np.uint8).T & 1, axis=1)
            planes[b : dim * bits : bits, : held.shape[1]] = held
        ones = np.packbits(np.ones(len(u), np.uint8))
        planes[-1, : len(ones)] = ones
        words = planes.view(np.uint64)
        for p in range(len(own)):
            common = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
            # A pair of planes of one dimension stands for both its orders.
            common[1:][own[p + 1 :] == own[p]] *= 2
            weight = bit[p] + bit[p:]
            heads = np.flatnonzero(np.diff(own[p:], prepend=-1))
            for k in range(int(weight.min()) // LIMB, int(weight.max()) // LIMB + 1):
                part = np.add.reduceat(np.where(weight // LIMB == k, common << (weight % LIMB), 0), heads)
                total.setdefault(k, np.zeros((dim + 1, dim + 1), np.int64))[own[p], own[p] :] += part
        k = 0
        while k in total:  # limbs stay below 2^LIMB
            over = total[k] >> LIMB
            total[k] &= (1 << LIMB) - 1
            if over.any():
                total.setdefault(k + 1, np.zeros((dim + 1, dim + 1), np.int64))
                total[k + 1] += over
            elif k + 1 not in total and any(m > k for m in total):
                total[k + 1] = np.zeros((dim + 1, dim + 1), np.int64)
            k += 1
    return total


_LIMBS = pa.schema([("dim", pa.int32()), ("limb", pa.int32()), ("row", pa.int32()), ("products", pa.binary())])


def _products(fit: DataFrame, ranges: dict[int, tuple[int, int]]) -> DataFrame:
    """(dim, limb, row, products): a matrix row's limb, summed over all tasks."""

    def slices(batches):
        for b in batches:
            for dim, part in by_length(b, 0):
                low, bits = ranges[dim]
                for k, matrix in cross_products(_integers(part.column(0), dim) - low, bits).items():
                    raw = [r.tobytes() for r in matrix]
                    size = len(raw)
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * size, pa.int32()), pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(raw, pa.binary())], schema=_LIMBS)

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for dim, k, row, raw in zip(*[c.to_pylist() for c in b.columns]):
                key = dim, k, row
                total[key] = total[key] + np.frombuffer(raw, np.int64) if key in total else np.frombuffer(raw, np.int64)
        for (dim, k, row), sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((dim, k, row, sums.tobytes()), _LIMBS.types)], schema=_LIMBS)

    kind = "dim int, limb int, row int, products binary"
    return fit.select("x").mapInArrow(slices, kind).mapInArrow(add, kind).repartition("dim", "row").mapInArrow(add, kind)


def axes_of(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(axes as rows, eigenvalues, trace) of the covariance with divisor n; arrays of Python integers.

    Eigenvalues that rounding alone explains are 0.  Each axis' largest component is positive.
    """
    centred = n * products - np.outer(sums, sums)
    v = (centred / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components].T
    values = np.where(values > len(v) * np.finfo(float).eps * abs(values[0]), values, 0.0)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return vectors * np.where(largest < 0, -1.0, 1.0)[:, None], values, float(np.trace(centred) / (n * n))


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, n, sums, axes, eigenvalues, explained) per length of ``fit`` (x: distinct integer vectors).

    A length's matrix is solved in one task; it has the size of the dimensions squared, whatever the rows.
    """
    found = fit.groupBy(F.size("x").alias("dim")).agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).collect()  # lengths, not vectors
    ranges = {r.dim: (r.low, max(1, (r.high - r.low).bit_length())) for r in found}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        upper = np.zeros((dim + 1, dim + 1), object)
        for k, row, raw in zip(rows["limb"], rows["row"], rows["products"]):
            upper[row] += np.frombuffer(raw, np.int64).astype(object) * (1 << (LIMB * int(k)))
        whole = np.triu(upper) + np.triu(upper, 1).T
        n, shifted, low = whole[dim, dim], whole[:dim, dim], ranges[dim][0]
        axes, values, trace = axes_of(n, shifted, whole[:dim, :dim], components)
        sums = [Decimal(int(s)) for s in shifted + n * low]
        explained = [v / trace if trace > 0 else None for v in values.tolist()]
        return pd.DataFrame({"dim": [dim], "n": [int(n)], "sums": [sums], "axes": [axes.tolist()], "eigenvalues": [values.tolist()], "explained": [explained]})

    kind = "dim int, n long, sums array<decimal(38,0)>, axes array<array<double>>, eigenvalues array<double>, explained array<double>"
    return stage(_products(fit, ranges).groupBy("dim").applyInPandas(solve, kind), "whitening-models")


def _rounds(models: DataFrame) -> list[tuple[int, int]]:
    """Ranges of lengths whose models are sent together."""
    out, held = [], 0
    for (dim,) in models.select("dim").orderBy("dim").collect():
        if out and held + dim * (COMPONENTS + 1) <= MODEL_NUMBERS:
            out[-1], held = (out[-1][0], dim), held + dim * (COMPONENTS + 1)
        else:
            out.append((dim, dim))
            held = dim * (COMPONENTS + 1)
    return out


def _whitened(rows: DataFrame, models: DataFrame, kind: str) -> DataFrame:
    """(id, dim, deviation, w) of rows (id, x)."""
    parts = None
    for low, high in _rounds(models):
        own = {m.dim: m for m in models.filter(F.col("dim").between(low, high)).collect()}  # at most MODEL_NUMBERS, or one model
        sent = rows.sparkSession.sparkContext.broadcast({d: (m.n, np.array([int(s) for s in m.sums], object), np.array(m.axes), np.array(m.eigenvalues)) for d, m in own.items()})

        def project(batches, sent=sent):
            for b in batches:
                for dim, part in by_length(b, 1):
                    n, sums, axes, values = sent.value[dim]
                    x = _integers(part.column(1), dim)
                    reach = n * max(int(x.max()), -int(x.min()), 0) + max(abs(s) for s in sums)
                    moved = n * (x if reach < 2**62 else x.astype(object)) - (sums.astype(np.int64) if reach < 2**62 else sums)
                    squared = moved if reach * reach * dim < 2**63 else moved.astype(object)
                    far = [d if d < 2**63 else None for d in (squared * squared).sum(axis=1).tolist()]
                    w = (moved / n).astype(np.float64) @ axes.T
                    w = [[y / s if s > 0 else None for y, s in zip(r, np.sqrt(values).tolist())] for r in w.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([dim] * len(x), pa.int32()), pa.array(far, pa.int64()), pa.array(w, pa.list_(pa.float64()))], ["id", "dim", "deviation", "w"])

        part = rows.filter(F.size("x").between(low, high)).mapInArrow(project, f"id {kind}, dim int, deviation long, w array<double>")
        parts = part if parts is None else parts.union(part)
    return parts if parts is not None else rows.limit(0).select("id", F.lit(0).alias("dim"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))


def _identity_errors(fit: DataFrame, models: DataFrame, components: int) -> DataFrame:
    """(dim, identity_error): the largest absolute entry of the whitened fit list's covariance less the identity, of components with a spread."""
    w = _whitened(fit.select(F.lit(0).alias("id"), "x"), models, "int").select("dim", *[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(components)])
    off = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - (1.0 if i == j else 0.0)) for i in range(components) for j in range(i, components)]
    return w.groupBy("dim").agg(F.greatest(*off, F.lit(None).cast("double")).alias("identity_error"))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component up to ``components``.

    Rows whose vector is null or empty, or holds null, non-finite or, times 256, numbers from 2^62 on, are
    dropped.  Each distinct vector of steps is in the fit once; vectors of another length have a fit of their own, n and the last
    two columns with it.  Rows that repeat an id, or have none, are rows like others.  Where a component has no spread
    (equal vectors, or fewer than components), whitened is null and identity_error leaves it out, null if none is left; explained is null where
    all vectors are equal.  A deviation beyond long is null.  Equal eigenvalues are taken as ``eigh`` gives them.
    An empty table gives an empty result; other columns aren't used.
    """
    kind = df.schema[vec_id].dataType.simpleString()
    rows = df.select(F.col(vec_id).alias("id"), steps(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    models = fit_models(fit, components)
    errors = _identity_errors(fit, models, components)
    # A length's model is one row, and rows of a length are many: both sides are salted by the rows.
    facts = models.join(errors, "dim").select("dim", "n", "explained", "identity_error")
    facts = stage(facts, "whitening-facts", drop=[fit])
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    placed = _whitened(rows, models, kind).withColumn("salt", F.pmod(F.xxhash64("id", "deviation", "w"), F.lit(64)).cast("int"))
    joined = placed.join(spread, ["dim", "salt"]).select("id", "n", "deviation", "explained", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return joined.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
