"""Embedding whitening from an exact, bit-sliced scatter matrix.

Vectors of the same length are whitened together. Their distinct integer vectors x = floor(scale * component) are the fit list.

1. Every task takes its rows of the fit list in blocks. A block shifts each dimension by its smallest value and slices what is left into
   bit planes across the rows, 64 rows a word. The sum over rows of u_i * u_j is the sum over planes p of i and q of j of
   2^(p+q) * popcount(plane_ip AND plane_jq), in integers; undoing the shift is integer arithmetic as well. A constant dimension in
   front gives the number of rows and the sums in the same way. A task hands on one number for each pair of dimensions.
2. These numbers are added up by pair of dimensions, as limbs of 40 bits, so nothing overflows or rounds. One row for each pair, not for
   each vector, reaches the task that centres them as integers, n * P_ij - S_i * S_j, divides once, and takes eigenvectors.
3. Rows are centred as integers, n * x - S, and projected. The identity error is measured on the whitened fit list.

Rows whose vector is null or empty or holds null or non-finite components, or one of more than 2^53 in x, take no part. Rows that repeat
teach once and are all returned; a null id is an id. A component without variance has whitened 0 and, if no component has any,
explained 0; it doesn't count in the identity error. A deviation beyond 64 bits is null. The driver and every task hold 5 numbers a
dimension for each length of vector that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import forget, table, written

SCALE, COMPONENTS = 256, 4
#: Rows that are sliced into planes together.
BLOCK = 8_192
#: Lengths of vectors that a task sums up at a time.
LENGTHS = 16
LIMB, LIMBS = 40, 5
LARGEST = 2.0**53

MOMENTS = "dim int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
WHITE = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("white", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64()))])
_WHITE = "vec_id long, dim int, n long, deviation long, white array<double>, explained array<double>"


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and x of the rows that take part."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) <= LARGEST))  # no comparison holds for NaN but that it is largest
    chosen = rows.where(x.isNotNull() & (F.size(x) > 0) & fit)
    return chosen.select("vec_id", F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative integers (rows, dimensions): words by plane, and each plane's dimension and place."""
    rows, dims = u.shape
    bits = [int(most).bit_length() for most in u.max(axis=0)]
    of = np.repeat(np.arange(dims), bits)
    place = np.concatenate([np.arange(b) for b in bits]) if len(of) else np.zeros(0, int)
    filled = np.zeros((len(of), -(-rows // 64) * 64), np.uint8)
    filled[:, :rows] = (u.T[of] >> place.astype(u.dtype)[:, None]) & u.dtype.type(1)
    return np.packbits(filled, axis=1).view(np.uint64), of, place


def sliced_products(u: np.ndarray) -> np.ndarray:
    """Sums over rows of u_i * u_j, exact; Python integers where 64 bits might not do."""
    rows, dims = u.shape
    words, of, place = planes(u)
    products = np.zeros((dims, dims), np.int64 if 2 * int(place.max(initial=0)) + 2 + rows.bit_length() < 63 else object)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for a in range(len(of)):
        from_here = starts[np.searchsorted(of[starts], of[a])]  # the first plane of the same dimension
        counts = np.bitwise_count(words[a] & words[from_here:]).sum(axis=1, dtype=np.int64).astype(products.dtype)
        weighed = counts * np.array([1 << int(p + place[a]) for p in place[from_here:]], products.dtype)
        here = starts[starts >= from_here]
        products[of[a], of[here]] += np.add.reduceat(weighed, here - from_here)
    upper = np.triu(products)
    return upper + np.triu(products, 1).T


def moments(x: np.ndarray) -> np.ndarray:
    """Sums over rows of x_i * x_j, where dimension 0 is 1 in every row, as Python integers."""
    rows, dims = x.shape
    shift = x.min(axis=0)
    u = (x - shift).astype(np.uint64)
    ones = np.array([1, *shift.tolist()], object)
    sums = np.array([0, *u.sum(axis=0, dtype=np.uint64).tolist()], object)
    held = np.zeros((dims + 1, dims + 1), object)
    held[1:, 1:] = sliced_products(u).astype(object)
    return held + np.multiply.outer(ones, sums) + np.multiply.outer(sums, ones) + rows * np.multiply.outer(ones, ones)


def limbs(value: int) -> list[int]:
    """`value` as the sum of limb k times 2^(LIMB * k); the last has the sign."""
    low = [(value >> LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> LIMB * (LIMBS - 1)]


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for dim, total in held.items():
            for i in range(dim + 1):
                parts = list(zip(*(limbs(int(v)) for v in total[i, i:]), strict=True))
                columns = [pa.array([dim] * (dim + 1 - i), pa.int32()), pa.array([i] * (dim + 1 - i), pa.int32()), pa.array(range(i, dim + 1), pa.int32())]
                yield pa.record_batch(columns + [pa.array(p, pa.int64()) for p in parts], names=["dim", "i", "j", *(f"l{k}" for k in range(LIMBS))])
        held.clear()

    for _, x in _matrices(batches):
        dim = x.shape[1]
        if dim not in held and len(held) >= LENGTHS:
            yield from flush()
        for start in range(0, len(x), BLOCK):
            held[dim] = held.get(dim, 0) + moments(x[start : start + BLOCK])
    yield from flush()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    """The ids (where there are any) and vectors of each batch by length of vector."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id") if "vec_id" in part.schema.names else None, flat.reshape(-1, dim)


@dataclass
class Model:
    """`sums` over the `n` vectors of the fit list; `axes` has a component a row, divided by the root of its eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]

    @staticmethod
    def fitted(total: list[list[int]], components: int) -> Model:
        """From the upper triangle of the moments."""
        n, sums = total[0][0], total[0][1:]
        dims = len(sums)
        cov = np.zeros((dims, dims))
        for i in range(dims):
            # integers up to the one division, which Python rounds correctly
            cov[i, i:] = [(n * p - sums[i] * sums[i + k]) / (n * n) for k, p in enumerate(total[i + 1])]
        values, vectors = np.linalg.eigh(cov + np.triu(cov, 1).T)
        order = np.argsort(-values, kind="stable")[:components]
        axes, explained, trace = [], [], float(np.trace(cov))
        for k in order:
            axis = vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
            real = values[k] > dims * np.finfo(float).eps * max(values.max(), 0)
            axes.append(axis / np.sqrt(values[k]) if real else np.zeros(dims))
            explained.append(float(values[k] / trace) if real else 0.0)
        return Model(n, sums, np.array(axes).reshape(-1, dims), explained)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = max(1, int(x.max()), -int(x.min()))
        if self.n * most + max(map(abs, self.sums)) >= 2**62:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, x.dtype)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares, null beyond 64 bits."""
        rough = (centred.astype(float) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0**62:
            whole = centred.astype(np.int64)
            return (whole * whole).sum(axis=1).tolist()
        exact = (sum(c * c for c in row) for row in centred.tolist())
        return [d if d < 2**63 else None for d in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector in `rows` (dim, x), each distinct vector once."""

    def solve(key: tuple, found: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        total = [[0] * (dim + 1 - i) for i in range(dim + 1)]
        columns = [found.column(f"l{k}").to_pylist() for k in range(LIMBS)]
        for i, j, *parts in zip(found.column("i").to_pylist(), found.column("j").to_pylist(), *columns, strict=True):
            total[i][j - i] = sum(p << LIMB * k for k, p in enumerate(parts))
        model = Model.fitted(total, components)
        return pa.table({"dim": pa.array([dim], pa.int32()), "n": [model.n], "sums": pa.array([[str(s) for s in model.sums]], pa.list_(pa.string())),
                         "axes": [model.axes.ravel().tolist()], "explained": [model.explained]})

    summed = rows.mapInArrow(_scatter, MOMENTS).groupBy("dim", "i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    solved = summed.groupBy("dim").applyInArrow(solve, "dim int, n long, sums array<string>, axes array<double>, explained array<double>")
    return {r.dim: Model(r.n, [int(s) for s in r.sums], np.array(r.axes).reshape(-1, r.dim), list(r.explained)) for r in solved.collect()}


def whiten(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """vec_id, dim, n, deviation, white and explained (an entry a component) of `rows` (vec_id, dim, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            model = models[x.shape[1]]
            centred = model.centred(x)
            white = (centred / model.n).astype(float) @ model.axes.T
            same = [x.shape[1]] * len(x), [model.n] * len(x), [model.explained] * len(x)
            yield pa.record_batch([ids, *(pa.array(c, f.type) for c, f in zip((same[0], same[1], model.deviations(centred), white.tolist(), same[2]), list(WHITE)[1:], strict=True))], schema=WHITE)

    return rows.mapInArrow(run, _WHITE)


def identity_error(rows: DataFrame, models: dict[int, Model]) -> float:
    """The largest entry, by absolute value, of the whitened fit list's covariance minus the identity. `rows` has dim and x."""
    most = max((len(m.explained) for m in models.values()), default=0)
    w = [F.get("white", F.lit(k)) for k in range(most)]
    entries = [F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(most) for j in range(i, most)]
    if not entries:
        return 0.0
    found = whiten(rows.withColumn("vec_id", F.lit(None).cast("long")), models).groupBy("dim").agg(*entries).collect()
    real = {dim: [e > 0 for e in m.explained] for dim, m in models.items()}
    errors = [
        abs(r[f"c{i}_{j}"] - (i == j))
        for r in found
        for i in range(len(real[r.dim]))
        for j in range(i, len(real[r.dim]))
        if real[r.dim][i] and real[r.dim][j]
    ]
    return float(max(errors, default=0.0))


def whitened(rows: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every row of `rows` (vec_id, embedding) that takes part."""
    held = integers(rows, scale)
    distinct = written(held.select("dim", "x").distinct(), "fit")
    models = fit(distinct, components)
    error = identity_error(distinct, models)
    forget(distinct)
    each = whiten(held, models).select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("white", "explained")).alias("place", "of"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.white").alias("whitened"),
        F.col("of.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all vectors."""
    return whitened(table(spark, sf_dir, "embeddings"))
