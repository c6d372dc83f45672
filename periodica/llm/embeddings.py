"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart.  The vectors are turned by one random
rotation and cut into blocks of few dimensions.  Each block has its proportional share of
the squared distance as budget; vectors within the whole distance are within budget in one
block at least.  In each block a range join on a grid of the budget's width brings together
what can be within it.  Candidates are compared exactly, on the vectors as they are given.
A pair that several blocks find counts in the first of them, so pairs need not be gathered
to be told apart: a task returns links counted by vector and a spanning set of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import staged
from periodica.llm.components import components

COSINE = 0.98
BLOCKS = 8
# Grid dimensions in a block.
GRID = 2
# Vectors of a grid cell that are compared in one piece; larger cells are cut into tiles.
TILE = 2048
# Room for rounding in the candidate search only.
SLACK = 1e-9

CELL = ["label", "dims", "block", "cell_0", "cell_1"]
PLACED = "label long, dims int, block int, cell_0 int, cell_1 int, home boolean, row long, vec binary"
FOUND = "row long, n_links long, other long"


@cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_ranges(dims: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def _rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; bit for bit the same for a vector whatever stands beside it."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    turn = rotation(x.shape[1])
    out = np.zeros_like(unit)
    for i in range(x.shape[1]):
        out += unit[:, i : i + 1] * turn[i]
    return out


def _budgets(dims: int, cosine: float, blocks: int) -> list[float]:
    return [(2 - 2 * cosine) * (b - a) / dims * (1 + SLACK) + SLACK**2 for a, b in block_ranges(dims, blocks)]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims).astype(np.float64)


def _placed(vectors: DataFrame, cosine: float, blocks: int, payload: bool) -> DataFrame:
    """Each vector in its cell of every block, and as a guest in half of the cells around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = np.array(batch.column("dims"))
            for dims in np.unique(all_dims).tolist():
                part = batch.filter(pa.array(all_dims == dims))
                turned = _rotated(_vectors(part.column("vec"), dims))
                n = len(turned)
                for k, ((a, b), budget) in enumerate(
                    zip(block_ranges(dims, blocks), _budgets(dims, cosine, blocks))
                ):
                    width = np.sqrt(budget)
                    cells = np.floor(turned[:, a : min(b, a + GRID)] / width).astype(np.int32)
                    if cells.shape[1] < GRID:
                        cells = np.hstack([cells, np.zeros((n, GRID - cells.shape[1]), dtype=np.int32)])
                    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("label"),
                                pa.array(np.full(n, dims, dtype=np.int32)),
                                pa.array(np.full(n, k, dtype=np.int32)),
                                pa.array(cells[:, 0] + np.int32(dx)),
                                pa.array(cells[:, 1] + np.int32(dy)),
                                pa.array(np.full(n, dx == dy == 0)),
                                part.column("row"),
                                part.column("vec") if payload else pa.nulls(n, pa.binary()),
                            ],
                            [c.split()[0] for c in PLACED.split(", ")],
                        )

    return vectors.mapInArrow(run, PLACED)


def _links(x, home, chunk, tile, block: int, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs that this block of this cell is the one to count."""
    dims = x.shape[1]
    turned, norm = _rotated(x), np.sqrt((x * x).sum(axis=1))
    ranges, budgets = block_ranges(dims, blocks), _budgets(dims, cosine, blocks)
    a, b = ranges[block]
    part = turned[:, a:b]
    square = (part * part).sum(axis=1)
    out = []
    hosts = np.flatnonzero(home)
    order = np.arange(len(x))
    for at in range(0, len(hosts), 512):
        own = hosts[at : at + 512]
        near = square[own][:, None] + square[None, :] - 2 * part[own] @ part.T <= budgets[block] + 1e-7
        near &= ~home[None, :] | (order[None, :] > own[:, None])  # a pair of hosts once
        if tile[0] != tile[1]:
            near &= chunk[own][:, None] != chunk[None, :]
        i, j = np.nonzero(near)
        i = own[i]
        for k in range(0, len(i), 20_000):
            p, q = i[k : k + 20_000], j[k : k + 20_000]
            apart = (turned[p] - turned[q]) ** 2
            take = apart[:, a:b].sum(axis=1) <= budgets[block]
            for (c, d), budget in zip(ranges[:block], budgets):
                take &= apart[:, c:d].sum(axis=1) > budget
            p, q = p[take], q[take]
            take = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
            out.append((p[take], q[take]))
    if not out:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    return tuple(np.concatenate(c) for c in zip(*out))


def _spanning(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place that each place is linked with, over any number of links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return label


def _compared(cells: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """(row, n_links, other): links by vector, and one that connects it, from sorted cells."""
    names = [*CELL, "tile_0", "tile_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([np.array(batch.column(c)) for c in names])
                edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                    yield tuple(keys[:, i].tolist()), batch.slice(i, j - i)

        for key, group in groupby(parts(), key=lambda part: part[0]):
            rows = pa.Table.from_batches([g for _, g in group]).combine_chunks()
            home = np.array(rows.column("home"))
            if len(home) < 2 or not home.any():
                continue
            x = _vectors(rows.column("vec"), key[1])
            p, q = _links(x, home, np.array(rows.column("chunk")), key[5:], key[2], cosine, blocks)
            if not len(p):
                continue
            counts = np.bincount(np.concatenate([p, q]), minlength=len(x))
            ids, some = np.array(rows.column("row")), np.flatnonzero(counts)
            label = _spanning(len(x), p, q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[label[some]])],
                ["row", "n_links", "other"],
            )

    return cells.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, FOUND)


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors are compared within their label and length.  Rows with a null label, and vectors
    that are null, empty or zero or hold a component that is null or not finite, link with
    nothing.  Rows of one vec_id are vectors of their own; a null id is kept, null unless
    linked with others.  Other columns are dropped; an empty table gives an empty one.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.coalesce(bad, F.lit(True))
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = staged(
        embeddings.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"),
            F.when(usable, F.col("embedding").cast("array<float>")).alias("embedding"),
        ),
        "vectors",
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            raw = [np.asarray(v, dtype=np.float32).tobytes() for v in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("label"),
                    pa.array([len(v) // 4 for v in raw], pa.int32()),
                    pa.array(raw, pa.binary()),
                ],
                ["row", "label", "dims", "vec"],
            )

    vectors = staged(
        rows.where("embedding is not null")
        .select("row", "label", "embedding")
        .mapInArrow(packed, "row long, label long, dims int, vec binary"),
        "packed",
    )
    crowded = (
        _placed(vectors, cosine, blocks, payload=False)
        .groupBy(*CELL)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
        .where("tiles > 1")
    )
    crowded = staged(crowded, "crowded-cells")
    tiles = F.coalesce("tiles", F.lit(1))
    chunk = F.pmod(F.xxhash64("row"), tiles).cast("int")
    cells = (
        _placed(vectors, cosine, blocks, payload=True)
        .join(crowded, CELL, "left")
        .withColumn("chunk", chunk)
        .withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumns({"tile_0": F.least("chunk", "with"), "tile_1": F.greatest("chunk", "with")})
        .drop("tiles", "with")
    )
    found = staged(_compared(cells, cosine, blocks), "links")
    counts = found.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    joined = components(found.select(F.col("row").alias("a"), F.col("other").alias("b")))
    placed = (
        rows.select("row", "vec_id")
        .join(counts, "row", "left")
        .join(joined.withColumnRenamed("node", "row"), "row", "left")
        .withColumn("component", F.coalesce("component", "row"))
    )
    placed = staged(placed, "placed")
    names = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed.join(names, "component").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
