"""Embedding near-dedup over an inverted multi-index.

Vectors, scaled to length 1, are cut into halves; each half has a codebook of its own (k-means on a sample of about
``SAMPLE`` vectors, ten for each codeword if that is more, fitted by the driver), and the pairs of codewords form a grid of cells. Each vector is filed
in its nearest cell and visits the nearest cells in the order of a multi-sequence traversal. How many cells it visits
is measured twice, and the larger number counts. ``QUERIES`` vectors are compared with all rows, and by visiting meet at
least ``RECALL`` of their links: the mean over queries, then over home cells, so that no hot vector or cell outweighs the
rest. And ``PAIRS`` made pairs right at the threshold, whose second vector lies in any direction or towards another
vector, meet as often, whether or not the table's own links are few. Vectors that meet are verified by their cosine in
double precision.

How it scales: a unit of work is a block of about ``BLOCK`` vectors filed in one cell and label, kept in memory, past
which its visitors stream; a cell with many vectors has many blocks, so no task holds a whole cell or label. A pair is
counted once: in its common cell, in the one cell where it meets, or in the lower of two. Linked pairs are never
emitted: a unit gives a count for each vector and edges that span the components it sees.

Rows: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label or id, link
with nothing. Vectors of different lengths don't link; each length has an index of its own. Every row is a vector, also
if others share its id. Equal vectors of a label are links like others, but one vertex before the index, which knows how
many they are; vertices have numbers of their own. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components, kept

COSINE = 0.93
SAMPLE = 20_000
QUERIES = 400
PAIRS = 1_000
RECALL = 0.98
BLOCK = 2_000
#: Vectors that a cell holds on average, up to about 800 million of them; the most codewords of a codebook, and vectors
#: of the sample for each at least.
PER_CELL = 48
CODEWORDS = 4096
PER_WORD = 10
ROUNDS = 12
#: Numbers of visits to choose from, each at most a twentieth or one more than the one before.
STEPS = np.unique(np.ceil(1.05 ** np.arange(260))).astype(np.int64)
STREAMED = 512


def unit(rows: pa.Array | np.ndarray) -> np.ndarray:
    """Vectors of length 1, one in each row."""
    if isinstance(rows, pa.Array):
        rows = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(1)[:, None] - 2 * points @ words.T + (words * words).sum(1), 0)


def codebook(points: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Codewords by k-means."""
    words = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = distances(points, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        size = np.bincount(nearest, minlength=len(words))
        words = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words)
    return words


def codewords(n_vectors: int) -> int:
    return int(np.clip(math.sqrt(n_vectors / PER_CELL), 2, CODEWORDS))


class Grid:
    def __init__(self, sample: np.ndarray, n_vectors: int):
        rng = np.random.default_rng(7)
        self.half = sample.shape[1] // 2
        n = codewords(n_vectors)
        self.left, self.right = codebook(sample[:, : self.half], n, rng), codebook(sample[:, self.half :], n, rng)
        self.visits = 1

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(vectors[:, : self.half], self.left), distances(vectors[:, self.half :], self.right)

    def traverse(self, vectors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest cells of each vector, nearest first, and their distances.

        The multi-sequence traversal reaches the cell of the i-th nearest left and j-th nearest right codeword only
        after the i * j cells that are no farther in both halves, so the first n are among those with i * j <= n.
        """
        a, b = self.halves(vectors)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        front = (i + 1) * (j + 1) <= n
        i, j = i[front], j[front]
        sums = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
        first = sums.argsort(1, kind="stable")[:, :n]
        cells = order_a[:, i] * len(self.right) + order_b[:, j]
        return np.take_along_axis(cells, first, 1), np.take_along_axis(sums, first, 1)

    def places(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each vector than the given one."""
        a, b = self.halves(vectors)
        out = np.zeros(len(vectors), np.int64)
        for k, cell in enumerate(cells):
            i, j = divmod(int(cell), len(self.right))
            out[k] = np.count_nonzero(a[k][:, None] + b[k] < a[k, i] + b[k, j])
        return out

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        return self.traverse(vectors, 1)[0][:, 0] if len(vectors) else np.zeros(0, np.int64)

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that each vector visits, its own first, and a distance that tells them from all others."""
        n = min(self.visits, self.cells)
        cells, far = self.traverse(vectors, min(n + 1, self.cells))
        limit = np.full(len(vectors), np.inf) if n == self.cells else (far[:, n - 1] + far[:, n]) / 2
        return cells[:, :n], limit


def usable(embeddings: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vec, ok) of all rows; only those that are ``ok`` can link."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    fine = fine & F.exists(embedding, lambda x: x != 0) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()
    return embeddings.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(embedding).alias("vec"),
        F.coalesce(fine, F.lit(False)).alias("ok"),
    )


def distinct(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one: (vec_id, label, vec, copies, first), ``first`` being their least id and ``vec_id``
    the vertex's own number. Numbers are given when this is written, so read it from where it was written."""
    one = vectors.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return one.select(F.monotonically_increasing_id().alias("vec_id"), "label", "vec", "copies", "first")


def enough(needed: np.ndarray, share: np.ndarray, recall: float) -> int:
    """The least number of visits at which links that need so many, each of its share, are met."""
    order = needed.argsort(kind="stable")
    met = np.cumsum(share[order])
    return int(needed[order][np.searchsorted(met, recall * met[-1] - 1e-9)])


def at_threshold(grid: Grid, vectors: np.ndarray, cosine: float, recall: float) -> int:
    """Visits by which made pairs of that cosine meet: either vector may visit the other's cell."""
    rng = np.random.default_rng(11)
    most = 1
    home = grid.homes(vectors)
    for other in (rng.normal(size=vectors.shape), vectors[rng.permutation(len(vectors))]):
        across = other - (other * vectors).sum(1, keepdims=True) * vectors
        size = np.sqrt((across * across).sum(1))
        good = size > 1e-6
        if not good.any():
            continue
        x, hx = vectors[good], home[good]
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * across[good] / size[good, None]
        needed = 1 + np.minimum(grid.places(x, grid.homes(y)), grid.places(y, hx))
        most = max(most, enough(needed, alike(hx), recall))
    return most


def alike(home: np.ndarray) -> np.ndarray:
    """Shares of queries by which each home cell counts the same."""
    _, which, size = np.unique(home, return_inverse=True, return_counts=True)
    return 1 / size[which]


def fit(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> Grid | None:
    """Codebooks from a bounded sample of ``distinct`` vectors, then the number of cells to visit: from bounded queries
    against all rows, and from pairs at the threshold."""
    total = vectors.count()
    if not total:
        return None

    def drawn(n: int, name: str) -> DataFrame:
        rate = max(1, math.ceil((1 << 40) * min(1.0, n / total)))
        return vectors.where(F.pmod(F.xxhash64(F.lit(name), "first", "label"), F.lit(1 << 40)) < rate)

    def some(n: int, name: str):
        rows = drawn(n, name).toPandas()
        return vectors.limit(1).toPandas() if rows.empty else rows

    sample = unit(np.stack(some(max(SAMPLE, PER_WORD * codewords(total)), "sample")["vec"].to_numpy()))
    grid = Grid(sample, total)
    asked = some(QUERIES, "queries")
    queries = unit(np.stack(asked["vec"].to_numpy()))
    grid.visits = at_threshold(grid, np.random.default_rng(9).permutation(sample)[:PAIRS], cosine, recall)
    held = vectors.sparkSession.sparkContext.broadcast((grid, asked["vec_id"].to_numpy(), asked["label"].to_numpy(), queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, labels, q = held.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                rows = unit(part.column("vec"))
                linked = q @ rows.T >= cosine
                linked &= labels[:, None] == part.column("label").to_numpy(zero_copy_only=False)
                linked &= ids[:, None] != part.column("vec_id").to_numpy()
                x, y = np.nonzero(linked)
                pairs, n = np.unique(x * own.cells + own.homes(rows)[y], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // own.cells), pa.array(pairs % own.cells), pa.array(n)], names=["query", "cell", "n"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, _, q = held.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                places = own.places(q[part.column("query").to_numpy()], part.column("cell").to_numpy())
                needed = STEPS[np.searchsorted(STEPS, places + 1)]
                yield pa.RecordBatch.from_arrays([part.column("query"), pa.array(needed), part.column("n")], names=["query", "needed", "n"])

    links = vectors.mapInArrow(run, "query long, cell long, n long").groupBy("query", "cell").agg(F.sum("n").alias("n"))
    links = links.mapInArrow(placed, "query long, needed long, n long").groupBy("query", "needed").agg(F.sum("n").alias("n"))
    found = links.toPandas()
    if len(found):
        per_query = found["n"] / found.groupby("query")["n"].transform("sum")
        own = found["query"].unique()
        weight = dict(zip(own, alike(grid.homes(queries[own])), strict=True))
        share = (per_query * found["query"].map(weight)).to_numpy()
        grid.visits = max(grid.visits, enough(found["needed"].to_numpy(), share, recall))
    return grid


def _rows(batch: pa.RecordBatch, grid: Grid) -> Iterator[pa.RecordBatch]:
    """A row for each vector and cell that it visits."""
    for begin in range(0, batch.num_rows, STREAMED):
        part = batch.slice(begin, STREAMED)
        cells, limit = grid.visited(unit(part.column("vec")))
        n = cells.shape[1]
        which = pa.array(np.repeat(np.arange(part.num_rows), n))
        columns = [part.column(c).take(which) for c in ("vec_id", "label", "vec", "copies")]
        columns += [pa.array(cells.ravel().astype(np.int32)), pa.array(np.repeat(cells[:, 0], n).astype(np.int32)), pa.array(np.repeat(limit, n))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vec", "copies", "cell", "home", "limit"])


class Block:
    """The vectors of one block, and what is found about them."""

    def __init__(self, grid: Grid, cosine: float, cell: int, rows: pa.RecordBatch):
        self.grid, self.cosine, self.cell = grid, cosine, cell
        self.ids, self.vectors = rows.column("vec_id").to_numpy(), unit(rows.column("vec"))
        self.copies = rows.column("copies").to_numpy().astype(np.float64)  # exact below 2^53, and fast in products
        self.limit = rows.column("limit").to_numpy()
        self.halves = grid.halves(self.vectors)
        self.count = np.zeros(len(self.ids), np.int64)
        self.label = np.arange(len(self.ids))
        for begin in range(0, len(self.ids), STREAMED):
            linked = self.vectors[begin : begin + STREAMED] @ self.vectors.T >= cosine
            linked &= np.arange(begin, begin + len(linked))[:, None] < np.arange(len(self.ids))
            self.count += (self.copies[begin : begin + STREAMED] @ linked).astype(np.int64)
            self.count[begin : begin + STREAMED] += (linked @ self.copies).astype(np.int64)
            linked[np.arange(len(linked)), np.arange(begin, begin + len(linked))] = True
            self._join(linked)

    def _join(self, linked: np.ndarray) -> None:
        """Members that one row links get the least of their labels, with all that share it."""
        linked = linked[linked.any(1)]
        while len(linked):
            least = np.where(linked, self.label, len(self.label)).min(1)
            new = np.minimum(self.label, np.where(linked, least[:, None], len(self.label)).min(0))
            if (new == self.label).all():
                break
            lower = np.arange(len(self.label))
            np.minimum.at(lower, self.label, new)
            self.label = lower[self.label]

    def visit(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        home = rows.column("home").to_numpy()
        linked = unit(rows.column("vec")) @ self.vectors.T >= self.cosine
        # A pair that also meets in the visitor's own cell counts in the lower of the two cells.
        x, y = np.nonzero(linked & (home < self.cell)[:, None])
        there = self.halves[0][y, home[x] // len(self.grid.right)] + self.halves[1][y, home[x] % len(self.grid.right)]
        twice = there <= self.limit[y]
        linked[x[twice], y[twice]] = False
        self._join(linked)
        n = (linked @ self.copies).astype(np.int64)
        self.count += (rows.column("copies").to_numpy().astype(np.float64) @ linked).astype(np.int64)
        some = n > 0
        yield found(rows.column("vec_id").to_numpy()[some], self.ids[linked[some].argmax(1)], n[some])

    def close(self) -> Iterator[pa.RecordBatch]:
        some = self.count > 0
        yield found(self.ids[some], self.ids[self.label][some], self.count[some])


def found(ids: np.ndarray, others: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(n.astype(np.int64))], names=["vec_id", "other", "n"])


def meet(vectors: DataFrame, grid: Grid, cosine: float = COSINE) -> DataFrame:
    """(vec_id, other, n): links of ``distinct`` vectors, each as often as the other has copies, counted in some unit of
    work, and an edge for the component."""
    held = vectors.sparkSession.sparkContext.broadcast(grid)
    kind = dict(vectors.dtypes)["vec"]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = held.value.homes(unit(batch.column("vec"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(home.astype(np.int32))], names=["label", "cell"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch, held.value)

    sizes = vectors.mapInArrow(homes, "label string, cell int").groupBy("label", "cell").agg(F.count("*").alias("held"))
    sizes = kept(sizes.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")).drop("held"), "cells")
    rows = vectors.mapInArrow(visits, f"vec_id long, label string, vec {kind}, copies long, cell int, home int, limit double")
    rows = rows.join(sizes, ["label", "cell"])
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("first", F.when(F.col("cell") == F.col("home"), own).otherwise(F.lit(0)))
    rows = rows.withColumn("block", F.explode(F.sequence("first", F.col("blocks") - 1)))
    visitor = (F.col("cell") != F.col("home")) | (F.col("block") != F.col("first"))
    rows = rows.select("label", "cell", "block", visitor.alias("visitor"), "vec_id", "home", "limit", "copies", "vec")
    unit_key = ["label", "cell", "block"]
    rows = rows.repartition(*unit_key).sortWithinPartitions(*unit_key, "visitor", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block = None, [], None
        for batch in batches:
            marks = [batch.column(c).to_pylist() for c in (*unit_key, "visitor")]
            marks = list(zip(*marks, strict=True))
            cuts = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                *new, visitor = marks[begin]
                if new != key:
                    if key is not None:
                        yield from (block or Block(held.value, cosine, key[1], joined(members))).close()
                    key, members, block = new, [], None
                part = batch.slice(begin, end - begin)
                if not visitor:
                    members.append(part)
                    continue
                block = block or Block(held.value, cosine, key[1], joined(members))
                for k in range(0, part.num_rows, STREAMED):
                    yield from block.visit(part.slice(k, STREAMED))
        if key is not None:
            yield from (block or Block(held.value, cosine, key[1], joined(members))).close()

    return rows.mapInArrow(run, "vec_id long, other long, n long")


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_duplicates(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """For each row: vec_id, n_links, component_id and kept."""
    rows = usable(embeddings, vec_id, embedding, label)
    vectors = kept(rows.where("ok").drop("ok"), "vectors")
    apart = kept(distinct(vectors), "distinct")
    linked = []
    for row in apart.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect():  # a row for each length
        own = apart.where(F.size("vec") == row.dim)
        linked.append(kept(meet(own, fit(own, cosine, recall), cosine), "links"))
    if not linked:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    met = reduce(DataFrame.unionByName, linked)
    counts = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = components(met, "vec_id", "other").withColumnRenamed("vertex", "vec_id")
    placed = apart.join(counts, "vec_id", "left").join(classes, "vec_id", "left").select(
        "label",
        "vec",
        "first",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("class"),
    )
    placed = kept(placed, "placed")
    least = kept(placed.groupBy("class").agg(F.min("first").alias("component")), "components")
    # What is joined is read from files, so that Spark can split the rows of a vector with very many copies.
    own = kept(placed.join(least, "class").select("label", "vec", "n_links", "component"), "own")
    each = vectors.join(own, ["label", "vec"]).select("vec_id", "n_links", "component")
    rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return each.unionByName(rest).select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
