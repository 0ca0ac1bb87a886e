"""Whitening of embeddings on the principal components of their covariance.

Entries become whole numbers, the fit list is every different vector once.  Sums over it are exact;
each partition then sums the outer products of its centred vectors, and the sums are added by matrix
row in two levels.  The driver splits the covariance, a matrix of fixed size, by QDWH spectral
divide and conquer: the polar factor U of the matrix less a shift gives the projector (U + I) / 2 on the
eigenvectors above the shift; both invariant subspaces are split again until each is one component.
Components are then broadcast (``COMPONENTS`` rows of the vectors' length) and all rows projected.

Defined results: null vectors and those with null or non-finite entries are dropped; so are vectors of
another length than most have (the shorter of two equally frequent lengths counts, length 0 never), for they have
no covariance with the rest.  Entries beyond +-2 ** 40 count as +-2 ** 40, so that all are exact doubles.
Repeated rows are returned one by one and fitted once; equal eigenvalues share their space in any
basis; a direction without variance has ``whitened`` null and ``explained`` 0 and does not enter
``identity_error``.  ``deviation`` is null where it exceeds a long; ``deviation_exact`` has it as a decimal.
An empty table gives an empty table; null ids and extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS, LANE = 16, 512
OFFSET, SCALE, LARGEST = 1_000_000, 64, float(1 << 40)


# --- the covariance's components, on the driver: matrices of the vectors' length ---


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor by QDWH: dynamically weighted Halley steps, each from a QR factorisation."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    # Where the shift is near an eigenvalue the smallest singular value is tiny; the bound only costs steps.
    low = max(np.linalg.norm(x, -2) * 0.9, 1e-16)
    eye = np.eye(n)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        a_k = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, eye]))
        new = b_k / c_k * x + (a_k - b_k / c_k) / np.sqrt(c_k) * q[:n] @ q[n:].T
        low = min(1.0, low * (a_k + b_k * square) / (1 + c_k * square))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-14 * n and abs(1 - low) < 1e-12:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below the shift, or None where they do not come apart."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-8 * n:
        return None
    # A QR of the projector's best-conditioned columns; a second pass over both bases cleans them.
    order = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
    q, _ = np.linalg.qr(np.hstack([projector[:, order] @ np.random.default_rng(7).normal(size=(n, rank)), np.eye(n)]))
    for _ in range(2):
        upper, _ = np.linalg.qr(projector @ q[:, :rank])
        q, _ = np.linalg.qr(np.hstack([upper, q[:, rank:]]))
    return q[:, :rank], q[:, rank:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)

    def parts(m: np.ndarray, basis: np.ndarray) -> list[np.ndarray]:
        n = len(m)
        mean = float(np.trace(m)) / n
        if n == 1 or np.linalg.norm(m - mean * np.eye(n)) <= 4e-16 * n * scale:
            return [basis]  # one component, or a space of equal eigenvalues
        diagonal = np.sort(np.diag(m))
        spread = float(np.linalg.norm(m - mean * np.eye(n))) / np.sqrt(n)
        # The mean always has eigenvalues on both sides; the median of the diagonal splits more evenly.
        shifts = [float((diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2), mean, *[mean + f * spread for f in (0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.4, -0.4)]]
        for shift in shifts:
            if (two := _split(m, shift)) is not None:
                return [x for q in two for x in parts((q.T @ m @ q + (q.T @ m @ q).T) / 2, basis @ q)]
        return [basis]

    vectors = np.hstack(parts(a, np.eye(len(a)))) if len(a) else np.zeros((0, 0))
    vectors, triangle = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(triangle) < 0, -1, 1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- tables ---


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(row, x) of the usable rows: the whole row in one column and its vector of whole numbers."""
    kept = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    lengths = kept.groupBy(F.size(vector).alias("length")).count().where("length > 0").orderBy(F.desc("count"), "length").head()
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + OFFSET
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    return kept.where(F.size(vector) == (lengths["length"] if lengths else 0)).select(row, F.transform(vector, entry).alias("x"))


@dataclass
class Model:
    n: int
    sums: list[int]
    values: np.ndarray  # of the leading components
    vectors: np.ndarray  # a column each
    trace: float
    error: float = 0.0

    def live(self) -> np.ndarray:
        """Components that have variance."""
        size = len(self.sums)
        return self.values > 1e-14 * size * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part in integers, so that no digit of x is lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        safe = np.where(self.live(), self.values, 1.0)
        return self.centred(x) @ self.vectors / np.sqrt(safe)

    def deviation(self, x: np.ndarray) -> list[str]:
        """Sum over dimensions of (n x - S) ** 2, in whole numbers of any size."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = x - whole
        if float(np.abs(y).max(initial=0) + 1) * self.n < 2.0**31 / np.sqrt(len(rest)):
            exact = y * self.n - np.array(rest, np.int64)
            return [str(v) for v in (exact * exact).sum(axis=1).tolist()]
        return [str(sum((v * self.n - r) ** 2 for v, r in zip(line, rest))) for line in y.tolist()]


def _summed(fit: DataFrame, width: int, made) -> np.ndarray:
    """Sum over the fit list of z' z, where ``made`` turns vectors into z: partial sums, added by matrix row."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in batches:
            z = made(np.stack(frame["x"]))
            total += z.T @ z
        yield pd.DataFrame({"line": range(width), "lane": TaskContext.get().partitionId() // LANE, "sums": [row.tobytes() for row in total]})

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in frame["sums"]], axis=0)
        return pd.DataFrame({"line": [key[0]], "lane": [key[-1]], "sums": [total.tobytes()]})

    schema = "line int, lane int, sums binary"
    lanes = fit.select("x").mapInPandas(partial, schema).groupBy("line", "lane").applyInPandas(added, schema)
    rows = lanes.groupBy("line").applyInPandas(added, schema).orderBy("line").collect()  # a square of the vectors' length
    return np.stack([np.frombuffer(bytes(r["sums"]), np.float64) for r in rows]) if rows else np.zeros((width, width))


def learn(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of ``integers(...)``; None without rows."""
    fit = stored(rows.select("x").distinct(), "fit-list")
    # Exact sums, a row per dimension; 38 digits hold more than 10 ** 18 vectors.
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.orderBy("at").collect()
    if not sums:
        return None
    n, width = int(sums[0]["n"]), len(sums)
    model = Model(n, [int(r["s"]) for r in sums], np.zeros(0), np.zeros((width, 0)), 0.0)
    shared = fit.sparkSession.sparkContext.broadcast(model)
    covariance = _summed(fit, width, lambda x: shared.value.centred(x)) / n
    values, vectors = eigen(covariance)
    kept = min(components, width)
    model = Model(n, model.sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)))
    whole = fit.sparkSession.sparkContext.broadcast(model)
    got = _summed(fit, kept, lambda x: whole.value.whiten(x)) / n
    live = model.live()
    model.error = float(np.abs(got - np.eye(kept))[np.ix_(live, live)].max(initial=0.0))
    return model


def whitened(rows: DataFrame, model: Model | None) -> DataFrame:
    """(row, deviation_exact, z) of the rows of ``integers(...)``, z an entry per component: a map, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1)
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = shared.value.whiten(x)
            dead = np.broadcast_to(~shared.value.live(), z.shape)
            entries = pa.array(z.ravel(), pa.float64(), mask=dead.ravel())
            bounds = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.deviation(x), pa.string()), pa.ListArray.from_arrays(bounds, entries)], names=["row", "deviation_exact", "z"]
            )

    return rows.select("row", "x").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, deviation_exact string, z array<double>")


def report(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The contract's rows: one per usable row and component."""
    rows = integers(embeddings.select(vec_id, vector), vector)
    model = learn(rows)
    wide = whitened(rows, model).select(F.col("row").getField(vec_id).alias("vec_id"), "deviation_exact", F.posexplode("z").alias("at", "whitened"))
    exact = F.col("deviation_exact")
    explained = _by_component([float(v) / model.trace if ok else 0.0 for v, ok in zip(model.values, model.live())] if model else [])
    return wide.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.expr("try_cast(deviation_exact as bigint)").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(model.error if model else 0.0).alias("identity_error"), exact.try_cast("decimal(38,0)").alias("deviation_exact"),
    )


def _by_component(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.col("at")] if values else F.lit(None).cast("double")
