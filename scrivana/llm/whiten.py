"""Whitening of embeddings by upper-triangle column aggregates.

Spark SQL expressions, generated one for each pair of places in a tile of 8 by 8 dimensions, sum centred products; a
vector meets every tile of the upper triangle, and one aggregation grouped by tile gives all pairs of dimensions. So the
plan stays the same size at any dimension, and a task holds as many sums as there are pairs, whatever the rows. The
driver puts the covariance together from those sums (never from vectors) and decomposes it with LAPACK.

Components are whole numbers x = floor(64 * c) + 1000000, centred at the whole number m nearest to their mean: products
and sums of y = x - m are whole numbers, exact while a sum stays below 2 ** 53, and what the mean lies off m is taken
out with exact fractions. So the result doesn't hang on the order of rows.

Rows take no part whose vector is null, empty or holds a null, a NaN, an infinity or a component that leaves a long when
scaled, nor rows of another dimension than the commonest (of equally common ones the smallest). Rows without an id, and
rows that repeat one, count like all others. Repeated vectors are fitted once, however many rows hold them. Directions
in which the vectors don't vary, or so little beside the first that doubles don't whiten them to ``WHITE``, aren't
returned; so one vector, or none, gives no rows. A deviation beyond the range of a long is given as the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch, parts_for

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions along a side of a tile.
TILE = 8
#: How far the whitened list's covariance may be off the identity.
WHITE = 1e-4
#: Rows of the fit list that one task sums.
FITTED = 100_000
#: Scaled components beyond this aren't whole numbers of a long.
WHOLE = float(1 << 62)
LONG = (1 << 63) - 1


def whole_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x of the rows that take part."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("c"))
    sound = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WHOLE / SCALE))
    return own.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(sound, F.lit(False))).select("id", F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


class Basis:
    """What the fit list tells: n, sums, eigenvectors by falling eigenvalue, and how white the whitened list is."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.middle = [round_half_even(s, n) for s in sums]
        self.off = np.array([(s - m * n) / n for s, m in zip(sums, self.middle)])
        values, vectors = np.linalg.eigh(covariance)
        noise = 16 * len(sums) * np.finfo(float).eps * max(float(values[-1]), 0.0)
        falling = np.argsort(-values, kind="stable")[:components]
        kept = falling[values[falling] > noise]
        self.values, self.vectors = values[kept], vectors[:, kept]
        self.explained = self.values / np.trace(covariance) if len(kept) else self.values
        self.identity_error = 0.0

    def keep(self, k: int, identity_error: float) -> None:
        self.values, self.vectors, self.explained, self.identity_error = self.values[:k], self.vectors[:, :k], self.explained[:k], identity_error

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.middle, dtype=np.int64)) - self.off) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum of (n * x - S) ** 2 of each row, exactly: with whole numbers without a limit where a long won't do."""
        y = x - np.array(self.middle, dtype=np.int64)
        off = np.array([s - m * self.n for s, m in zip(self.sums, self.middle)], dtype=object)
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n**2 * y.shape[1] < LONG:
            return ((y * self.n - off.astype(np.int64)) ** 2).sum(axis=1)
        return [min(LONG, sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(row, off))) for row in y]


def round_half_even(s: int, n: int) -> int:
    whole, rest = divmod(s, n)
    return whole + (2 * rest > n or (2 * rest == n and whole % 2 == 1))


def centred_products(fit: DataFrame, centred: str, dim: int) -> np.ndarray:
    """Sums over all rows of the products of every two dimensions of ``centred`` (SQL of an array of doubles)."""
    side = parts_for(dim, TILE)
    tiles = f"flatten(transform(sequence(0, {side - 1}), a -> transform(sequence(a, {side - 1}), b -> a * {side} + b)))"
    met = fit.selectExpr(f"{centred} AS y").selectExpr("y", f"explode({tiles}) AS tile")
    places = [f"coalesce(get(y, tile {op} {side} * {TILE} + {i}), 0D) AS {name}{i}" for name, op in (("a", "div"), ("b", "%")) for i in range(TILE)]
    rows = met.selectExpr("int(tile) AS tile", *places)
    sums = [F.expr(f"sum(a{i} * b{j})").alias(f"p{i}_{j}") for i in range(TILE) for j in range(TILE)]
    out = np.zeros((side * TILE, side * TILE))
    for tile, *products in rows.groupBy("tile").agg(*sums).collect():
        a, b = divmod(tile, side)
        out[a * TILE : (a + 1) * TILE, b * TILE : (b + 1) * TILE] = np.reshape(products, (TILE, TILE))
    return np.triu(out)[:dim, :dim]


def mirrored(upper: np.ndarray) -> np.ndarray:
    return upper + np.triu(upper, 1).T


def fit_basis(fit: DataFrame, dim: int, components: int) -> Basis | None:
    """fit: each distinct x once. Centres come first, then all products of centred dimensions."""
    row = fit.agg(F.count(F.lit(1)), *(F.try_sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim))).first()
    n, sums = int(row[0]), list(row[1:])
    if not n:
        return None
    if None in sums:  # beyond a long
        sums = list(fit.agg(*(F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim))).first())
    sums = [int(s) for s in sums]
    middle = [round_half_even(s, n) for s in sums]
    centres = ", ".join(f"{m}L" for m in middle)
    products = centred_products(fit, f"zip_with(x, array({centres}), (v, m) -> double(v - m))", dim)
    off = [s - m * n for s, m in zip(sums, middle)]
    covariance = np.zeros((dim, dim))
    for i, j in zip(*np.triu_indices(dim)):
        covariance[i, j] = (int(products[i, j]) * n - off[i] * off[j]) / n**2
    return Basis(n, sums, mirrored(covariance), components)


def whiten(spark: SparkSession, rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row that takes part and each of
    the first ``components`` components."""
    scratch = scratch or Scratch(spark, "whiten")
    sound = whole_rows(rows, key, vector)
    sizes = sound.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n_rows = int(sizes["dim"]), int(sizes["n"])
    sound = sound.where(F.size("x") == dim)
    # grouped by all components: partial groups first, so a vector that a third of all rows hold is one row a task
    fit = scratch.put("fit", sound.groupBy("x").agg(F.lit(1).alias("one")).select("x").coalesce(parts_for(n_rows, FITTED, 8)))
    basis = fit_basis(fit, dim, components)
    if basis is None or not len(basis.values):
        return spark.createDataFrame([], schema)
    k = len(basis.values)

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def white_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = basis.whitened(vectors_of(batch))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))], names=["w"])

    white = fit.mapInArrow(white_list, "w array<double>")
    off = np.abs(mirrored(centred_products(white, "w", k)) / basis.n - np.eye(k))
    while k and off[:k, :k].max() > WHITE:
        k -= 1
    if not k:
        return spark.createDataFrame([], schema)
    basis.keep(k, float(off[:k, :k].max()))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = vectors_of(batch), batch.num_rows
            if not m:
                continue
            columns = {
                "vec_id": batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, basis.n, dtype=np.int64)),
                "deviation": pa.array(np.repeat(np.array(basis.deviations(x), dtype=np.int64), k)),
                "whitened": pa.array(basis.whitened(x).ravel()),
                "explained": pa.array(np.tile(basis.explained, m)),
                "identity_error": pa.array(np.full(m * k, basis.identity_error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return sound.mapInArrow(give, schema)
