"""Pairwise-complete correlations of many columns, tile by tile of the matrix.

A wide aggregate with several buffers per pair outgrows generated code after a
dozen pairs. Here the asked pairs are dealt to tiles of at most ``BAND`` by
``BAND`` columns, and every task turns its Arrow batches into one small block of
moments per tile: with ``Z`` the values (0 where missing) and ``M`` their presence,
``MᵀM``, ``ZᵀM``, ``(Z²)ᵀM`` and ``ZᵀZ`` hold the counts and sums of every pair
over its own complete rows. Columns that no pair asks for aren't read, and p
features against one target take p products.

A task sends one binary block per tile. Blocks are merged by their means, so no
large sums are subtracted, in two rounds: whatever the number of tasks, at most
``FAN`` blocks of a tile are left after the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.functions.columns import as_double, union_all

BAND = 64  # columns on a side of a tile; a block has 8 numbers a pair, 256 KB at most
FAN = 32  # blocks of a tile that the second round meets
TILES = 512  # tiles of one scan: 128 MB of blocks in a task at most
CONSTANT = 1e-12  # spread below this share of the size is rounding noise
BLOCK = "tile int, state binary"
#: Numbers of a block, each a matrix over the pairs of a tile.
N, MEAN_X, MEAN_Y, SXX, SYY, SXY, SIZE_X, SIZE_Y = range(8)


@dataclass(frozen=True)
class Tile:
    rows: list[int]
    columns: list[int]
    pairs: list[tuple[int, int]]

    @property
    def shape(self) -> tuple[int, int, int]:
        return 8, len(self.rows), len(self.columns)


def tiles_of(pairs: list[tuple[int, int]]) -> list[Tile]:
    boxes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in pairs:
        boxes.setdefault((i // BAND, j // BAND), []).append((i, j))
    return [Tile(sorted({i for i, _ in box}), sorted({j for _, j in box}), box) for box in boxes.values()]


def _batch(values: np.ndarray, tiles: list[tuple[list[int], list[int]]]) -> list[np.ndarray]:
    """The blocks of one batch; a tile is given by positions in ``values``."""
    seen = ~np.isnan(values)
    first = values[seen.argmax(axis=0), np.arange(values.shape[1])]
    z = np.where(seen, values - np.where(seen.any(axis=0), first, 0.0), 0.0)  # a constant column becomes exactly 0
    shift, m, squares = np.where(seen.any(axis=0), first, 0.0), seen.astype(float), z * z
    out = []
    for x, y in tiles:
        n = m[:, x].T @ m[:, y]
        safe = np.maximum(n, 1.0)
        sum_x, sum_y = z[:, x].T @ m[:, y], m[:, x].T @ z[:, y]
        square_x, square_y = squares[:, x].T @ m[:, y], m[:, x].T @ squares[:, y]
        spread_x, spread_y = square_x - sum_x * sum_x / safe, square_y - sum_y * sum_y / safe
        spread_x[spread_x <= CONSTANT * square_x] = 0.0
        spread_y[spread_y <= CONSTANT * square_y] = 0.0
        product = z[:, x].T @ z[:, y] - sum_x * sum_y / safe
        mean_x, mean_y = shift[x][:, None] + sum_x / safe, shift[y][None, :] + sum_y / safe
        here = n > 0
        out.append(np.stack([n, mean_x, mean_y, spread_x, spread_y, product,
                             np.where(here, np.abs(mean_x), 0.0), np.where(here, np.abs(mean_y), 0.0)]))
    return out


def _merge(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Two blocks of a tile in one, by the difference of their means."""
    if a is None:
        return b
    n = a[N] + b[N]
    safe, both = np.maximum(n, 1.0), (a[N] > 0) & (b[N] > 0)
    weight, share = a[N] * b[N] / safe, b[N] / safe
    gap_x = np.where(both, b[MEAN_X] - a[MEAN_X], 0.0)
    gap_y = np.where(both, b[MEAN_Y] - a[MEAN_Y], 0.0)
    known = a[N] > 0
    return np.stack([
        n, np.where(known, a[MEAN_X] + gap_x * share, b[MEAN_X]), np.where(known, a[MEAN_Y] + gap_y * share, b[MEAN_Y]),
        a[SXX] + b[SXX] + gap_x * gap_x * weight, a[SYY] + b[SYY] + gap_y * gap_y * weight,
        a[SXY] + b[SXY] + gap_x * gap_y * weight,
        np.maximum(a[SIZE_X], b[SIZE_X]), np.maximum(a[SIZE_Y], b[SIZE_Y])])


def _correlations(block: np.ndarray) -> np.ndarray:
    """r of a tile's pairs, NaN where undefined."""
    safe = np.maximum(block[N], 1.0)
    varies = (np.sqrt(block[SXX] / safe) > CONSTANT * block[SIZE_X]) & (np.sqrt(block[SYY] / safe) > CONSTANT * block[SIZE_Y])
    with np.errstate(all="ignore"):
        r = block[SXY] / (np.sqrt(block[SXX]) * np.sqrt(block[SYY]))
    return np.where(varies & (block[N] > 0), np.clip(r, -1.0, 1.0), np.nan)


def _blocks(rows: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for tile, block in rows:
        yield pa.record_batch({"tile": pa.array([tile], pa.int32()), "state": pa.array([block.tobytes()], pa.binary())})


def _measure(tiles: list[Tile], first: int, used: list[int]) -> Callable:
    """One block per tile of a task's rows."""
    at = {c: k for k, c in enumerate(used)}
    places = [([at[i] for i in t.rows], [at[j] for j in t.columns]) for t in tiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [None] * len(places)
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                total = [_merge(a, b) for a, b in zip(total, _batch(values, places))]
        yield from _blocks([(first + k, b) for k, b in enumerate(total) if b is not None])

    return run


def _gather(batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray | None]]:
    """Rows that come sorted by tile, merged tile by tile; one block at a time is held."""
    stream = ((t.as_py(), s.as_py()) for batch in batches for t, s in zip(*batch.columns))
    for tile, rows in groupby(stream, key=lambda r: r[0]):
        total = None
        for _, state in rows:
            if state is not None:
                total = _merge(total, np.frombuffer(state).reshape(shapes[tile]))
        yield tile, total


def pair_correlations(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """``i, j, corr`` for the given column pairs; NULL where undefined."""
    spark, tiles = df.sparkSession, tiles_of(pairs)
    if not tiles:
        return spark.createDataFrame([], "i int, j int, corr double")
    shapes = [t.shape for t in tiles]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, block in _gather(batches, shapes):
            yield from _blocks([(tile, block)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, block in _gather(batches, shapes):
            own = tiles[tile]
            found = np.full(shapes[tile][1:], np.nan) if block is None else _correlations(block)
            x, y = {c: k for k, c in enumerate(own.rows)}, {c: k for k, c in enumerate(own.columns)}
            values = np.array([found[x[i], y[j]] for i, j in own.pairs])
            yield pa.record_batch({"i": pa.array([i for i, _ in own.pairs], pa.int32()),
                                   "j": pa.array([j for _, j in own.pairs], pa.int32()),
                                   "corr": pa.array(values, pa.float64(), mask=np.isnan(values))})

    scans = []
    for at in range(0, len(tiles), TILES):
        part = tiles[at:at + TILES]
        used = sorted({c for t in part for c in (*t.rows, *t.columns)})
        wide = df.select(*[as_double(columns[c]).alias(f"c{c}") for c in used])
        scans.append(wide.mapInArrow(_measure(part, at, used), BLOCK).withColumn("lane", F.spark_partition_id() % FAN))
    blocks = union_all(scans).repartition("tile", "lane").sortWithinPartitions("tile").select("tile", "state").mapInArrow(merge, BLOCK)
    # Every tile has a row, also where the table has none.
    every = spark.range(len(tiles)).select(F.col("id").cast("int").alias("tile"), F.lit(None).cast("binary").alias("state"))
    return (blocks.unionByName(every).repartition("tile").sortWithinPartitions("tile")
            .mapInArrow(finish, "i int, j int, corr double"))
