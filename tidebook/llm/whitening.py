"""Embedding whitening by shifted CholeskyQR.

Vectors are quantised to whole numbers, x = floor(64 * c) + 1000000. The fit list has each distinct x once: n of them,
with sums S. A is the matrix of its rows less their mean S / n. Its covariance is never formed for the components, as
that would square what separates large from small ones. Instead distributed passes over A find a triangular R with
A = Q R and orthonormal Q: a pass adds up the Gram matrix of the rows as they are by now (``gram``), the driver factors
it by Cholesky, and the next pass solves each row by all factors so far. Gram matrices too near to singular are shifted
first; passes go on until Q is orthonormal to rounding. The product of the factors is R, and the singular values and
right singular vectors of R are those of A: the components, with e = s^2 / n.

What the driver holds is a matrix as wide as a vector, whatever the number of rows. The fit list is found by one
aggregation that combines equal vectors before the shuffle, and is written once; passes only read it.

Rows: vectors that are null or hold null, non-finite entries or such that don't fit a long are left out, also for the
counts; empty vectors have no components. Vectors of different lengths are spaces of their own, each whitened by
itself. Components along which nothing varies (singular value below ``LEAST`` of the largest) are left out, so a table
of equal vectors, or an empty one, gives no rows. Repeated rows and rows with a null id give rows each.
``deviation`` is exact; it is null where a long can't hold it. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import kept

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes at most, and the entry of Q'Q - I by which Q counts as orthonormal, for each number of a vector.
PASSES = 10
ORTHONORMAL = 1e-14
LEAST = 1e-12
#: Rows that are multiplied together.
ROWS = 4096
UNIT = np.finfo(float).eps / 2
LONG = 1 << 63

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(embedding: str) -> Column:
    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < 2.0**62)

    return F.col(embedding).isNotNull() & F.forall(embedding, fine)


def quantised(embedding: str) -> Column:
    return F.transform(embedding, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(OFFSET).cast("long"))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            yield part, matrix(part.column(column))


class Sums:
    """n, the exact sums S, and what is needed to take the mean from a row without losing digits."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]
        self.rest = np.array([(s - n * b) / n for s, b in zip(sums, self.base, strict=True)])
        self.base_row = np.array(self.base, np.int64)
        self.widest = max((max(h - b, b - l) for l, h, b in zip(low, high, self.base, strict=True)), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base_row).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over a row's numbers of (n * x - S)^2."""
        left = [s - self.n * b for s, b in zip(self.sums, self.base, strict=True)]
        most = self.n * (self.widest + 1)
        if len(left) * most * most < LONG:
            off = self.n * (x - self.base_row) - np.array(left, np.int64)
            return (off * off).sum(1).tolist()
        off = self.n * (x - self.base_row).astype(object) - np.array(left, object)
        return [v if v < LONG else None for v in (off * off).sum(1).tolist()]


def added_up(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Rows of (slot, held), added up by slot; slots are as many as a vector has numbers, and few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, own in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                total[slot] = total[slot] + own if slot in total else own.copy()
        yield slot_rows(total)

    schema = f"slot int, held array<{kind}>"
    return {r.slot: np.array(r.held) for r in rows.repartition("slot").mapInArrow(run, schema).collect()}


def slot_rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    sizes = np.cumsum([0, *map(len, total.values())]).astype(np.int32)
    flat = np.concatenate([*total.values()]) if total else np.zeros(0)
    held = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), held], names=["slot", "held"])


def sums(fit: DataFrame) -> Sums | None:
    """Exact sums: each number in two halves of 32 bits, which fit longs for two billion rows of a task."""
    aggregates = fit.agg(F.count("*").alias("n")).first()
    if not aggregates.n:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = None, None, None
        for _, x in parts(batches, 0):
            own = np.stack([(x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)])
            total = own if total is None else total + own
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if total is not None:
            held = [total.ravel().tolist() + low.tolist() + high.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int64()))], names=["held"])

    # A row for each task: few numbers each, combined by Spark before they reach the driver.
    each = fit.mapInArrow(run, "held array<long>").select(F.posexplode("held").alias("k", "v")).groupBy("k")
    rows = each.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = {r.k: r for r in rows.collect()}
    d = len(found) // 4
    exact = [int(found[k].s) + (int(found[d + k].s) << 32) for k in range(d)]
    return Sums(aggregates.n, exact, [found[2 * d + k].low for k in range(d)], [found[3 * d + k].high for k in range(d)])


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, column after column."""
    out = np.empty_like(rows)
    for k in range(rows.shape[1]):
        out[:, k] = (rows[:, k] - out[:, :k] @ factor[:k, k]) / factor[k, k]
    return out


def gram(fit: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the rows that ``made`` makes of the fit list's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in parts(batches, 0):
            rows = made(x)
            own = np.concatenate([rows.T @ rows, rows.sum(0)[None]])
            total = own if total is None else total + own
        if total is not None:
            yield slot_rows(dict(enumerate(total)))

    found = added_up(fit.mapInArrow(run, "slot int, held array<double>"), "double")
    whole = np.stack([found[k] for k in range(len(found))])
    return whole[:-1], whole[-1]


def factor_of(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, its columns scaled to be alike; shifted if told to or if need be."""
    size = np.sqrt(np.diag(g))
    size[size == 0] = 1
    scaled = g / np.outer(size, size)
    d = len(g)
    bump = min(max(11 * (d * n + d * (d + 1)) * UNIT * np.linalg.eigvalsh(scaled)[-1], 16 * UNIT), 1e-2)
    for added in (*(() if shift else (0.0,)), *bump * 10.0 ** np.arange(16)):
        try:
            return np.linalg.cholesky(scaled + added * np.eye(d)).T * size
        except np.linalg.LinAlgError:
            continue
    raise ValueError("a Gram matrix without a factor")


def triangular(fit: DataFrame, stats: Sums) -> np.ndarray:
    """R of A = Q R."""
    factors: list[np.ndarray] = []
    r = None
    for k in range(PASSES):
        held = fit.sparkSession.sparkContext.broadcast((stats, list(factors)))

        def made(x: np.ndarray, held=held) -> np.ndarray:
            own, upto = held.value
            rows = own.centred(x)
            for f in upto:
                rows = solved(rows, f)
            return rows

        g, _ = gram(fit, made)
        held.unpersist()
        if k and np.abs(g - np.eye(len(g))).max() <= ORTHONORMAL * len(g) * max(1.0, np.sqrt(stats.n)):
            break
        own = factor_of(g, stats.n, not k)
        factors.append(own)
        r = own if r is None else own @ r
    else:
        # Directions along which rows don't vary never become orthonormal; the rest of Q'Q is factored as it is.
        values, vectors = np.linalg.eigh(gram_of_last(g, own))
        r = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ r
    return r


def gram_of_last(g: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Gram matrix of rows after they were solved by ``factor``, from the one before."""
    return solved(solved(g, factor).T, factor).T


def principal(fit: DataFrame, stats: Sums, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as columns, their variances, and the shares of the whole that these explain."""
    _, s, vt = np.linalg.svd(triangular(fit, stats))
    e = s * s / stats.n
    n = int(min(most, np.count_nonzero(s > LEAST * s[0]))) if s[0] > 0 else 0
    return vt[:n].T, e[:n], e[:n] / e.sum() if n else e[:0]


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component (from 1, by falling variance): vec_id, component, n, deviation, whitened,
    explained and identity_error, the largest entry of the whitened fit list's covariance less the identity."""
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), quantised(embedding).alias("x"))
    every = kept(rows.select("x").distinct(), "fit-list")
    lengths = [r.d for r in every.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy("d").collect()]
    out = None
    for d in lengths:
        one = whitened(rows.where(F.size("x") == d), every.where(F.size("x") == d).select("x"), components)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], OUT) if out is None else out


def whitened(rows: DataFrame, fit: DataFrame, most: int) -> DataFrame:
    stats = sums(fit)
    axes, e, share = principal(fit, stats, most)
    spark = rows.sparkSession
    scaled = axes / np.sqrt(e)
    held = spark.sparkContext.broadcast((stats, scaled))

    def made(x: np.ndarray) -> np.ndarray:
        own, by = held.value
        return own.centred(x) @ by

    error = 0.0
    if len(e):
        g, total = gram(fit, made)
        mean = total / stats.n
        error = float(np.abs(g / stats.n - np.outer(mean, mean) - np.eye(len(e))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(share)
        for part, x in parts(batches, 1):
            if not n:
                continue
            which = np.repeat(np.arange(len(x)), n)
            values = made(x).ravel()
            deviation = pa.array(held.value[0].deviations(x), pa.int64()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(values), stats.n, np.int64)),
                    deviation,
                    pa.array(values),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(values), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, OUT)
