"""Rasters as cell tables (row, col, value), worked on as tiles: overlays, slopes, focal statistics, flow of water."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, table

#: Cells along a tile's side: 512 kB a layer.
TILE = 256
#: Where a cell's water may go, as steps of (row, col); of equal drops the first is taken.
STEPS = np.array([(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])


def tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(ty, tx, values) of cells(row, col, value): squares of size by size cells, row after row, NaN where no value is.

    Cells without a value or place are left out; of cells that repeat the mean is taken. A tile's cells are one group,
    size * size of them at most.
    """
    one = cells.where("row is not null and col is not null and not isnan(value)").groupBy("row", "col").agg(F.avg("value").alias("value"))
    at = one.select(*[F.floor(F.col(c) / size).cast("int").alias(t) for c, t in (("row", "ty"), ("col", "tx"))], (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("at"), "value")

    def filled(t: pa.Table) -> pa.Table:
        values = np.full(size * size, np.nan)
        values[t["at"].to_numpy()] = t["value"].to_numpy()
        return _tile(t, {"values": values})

    return at.groupBy("ty", "tx").applyInArrow(filled, "ty int, tx int, values array<double>")


def _tile(t: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    key = {c: pa.array([t[c][0].as_py()], pa.int32()) for c in ("ty", "tx")}
    return pa.table(key | {n: pa.array([v.ravel()], pa.list_(pa.float64())) for n, v in columns.items()})


def cells(tiled: DataFrame, columns: dict[str, str], size: int = TILE) -> DataFrame:
    """(row, col and columns, by their new names) of tiles: the cells whose first column is a number; null for NaN elsewhere."""
    at = tiled.select("ty", "tx", F.posexplode(F.arrays_zip(*columns)).alias("at", "v")).where(~F.isnan(F.col("v").getField(next(iter(columns)))))
    place = [(F.col(t) * size + p).cast("int").alias(n) for t, p, n in (("ty", F.floor(F.col("at") / size), "row"), ("tx", F.col("at") % size, "col"))]
    value = lambda c: F.when(~F.isnan(F.col("v").getField(c)), F.col("v").getField(c))
    return at.select(*place, *[value(c).alias(n) for c, n in columns.items()])


def focal(tiled: DataFrame, work: Callable[[np.ndarray], list[np.ndarray]], columns: list[str], radius: int = 1, size: int = TILE) -> DataFrame:
    """(ty, tx, columns) of what work makes of each tile with a margin of `radius` cells of its eight neighbours.

    A tile travels once, and strips of it go to its neighbours. work gets NaN where no value is, as beyond the raster.
    """
    if not 0 < radius <= size:
        raise ValueError("the radius must be from 1 to a tile's side")
    span = {-1: (0, radius), 0: (0, size), 1: (size - radius, radius)}
    lies = {1: slice(0, radius), 0: slice(radius, radius + size), -1: slice(radius + size, None)}

    def strip(dy: int, dx: int) -> Column:
        (top, high), (left, wide) = span[dy], span[dx]
        lines = F.transform(F.sequence(F.lit(top), F.lit(top + high - 1)), lambda i: F.slice("values", i * size + left + 1, wide))
        values = F.flatten(lines) if dy or dx else F.col("values")
        return F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), values.alias("values"))

    sent = tiled.select(F.explode(F.array(*[strip(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])).alias("s")).select("s.*")

    def met(t: pa.Table) -> pa.Table:
        wide, own = np.full((size + 2 * radius,) * 2, np.nan), False
        for dy, dx, values in zip(t["dy"].to_pylist(), t["dx"].to_pylist(), t["values"], strict=True):
            part = wide[lies[dy], lies[dx]]
            part[:] = values.values.to_numpy(zero_copy_only=False).reshape(part.shape)
            own |= dy == dx == 0
        done = _tile(t, dict(zip(columns, work(wide), strict=True)))
        return done if own else done.slice(0, 0)

    return sent.groupBy("ty", "tx").applyInArrow(met, "ty int, tx int" + "".join(f", {c} array<double>" for c in columns))


def overlay(layers: dict[str, DataFrame], weights: dict[str, float], size: int = TILE) -> DataFrame:
    """(row, col, value): the weighted sum of layers where all have a cell; layers meet tile by tile."""
    weighted = lambda w: F.transform("values", lambda v: v * w)
    named = [tiles(df, size).select("ty", "tx", weighted(weights[n]).alias(n)) for n, df in layers.items()]
    joined = reduce(lambda a, b: a.join(b, ["ty", "tx"]), named)
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(n) for n in layers])
    return cells(joined.select("ty", "tx", total.alias("values")), {"values": "value"}, size)


def focal_mean(of: DataFrame, radius: int = 1, size: int = TILE) -> DataFrame:
    """(row, col, value): the mean over the square about each of the cells(row, col, value)."""

    def mean(p: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(p)
        total, n = np.where(there, p, 0.0), there.astype(float)
        for axis in (0, 1):
            total, n = (np.lib.stride_tricks.sliding_window_view(x, 2 * radius + 1, axis).sum(-1) for x in (total, n))
        return [np.where(there[radius:-radius, radius:-radius], total / np.maximum(n, 1), np.nan)]

    return cells(focal(tiles(of, size), mean, ["values"], radius, size), {"values": "value"}, size)


def ahp(pairs: DataFrame) -> DataFrame:
    """(i, weight): priorities from a reciprocal comparison table (i, j, v) by geometric means."""
    means = pairs.groupBy("i").agg(F.exp(F.avg(F.ln("v"))).alias("g"))
    total = means.agg(F.sum("g").alias("total"))
    return means.join(F.broadcast(total)).select("i", (F.col("g") / F.col("total")).alias("weight"))  # one row


def slope_aspect(of: DataFrame, width: float = 1.0, size: int = TILE) -> DataFrame:
    """(row, col, slope, aspect) in degrees of cells(row, col, value) with four neighbours, rows running south.

    Central differences over cells that are `width` wide; aspect is the compass direction that the slope faces, 0 north,
    null on flat ground.
    """

    def slope(p: np.ndarray) -> list[np.ndarray]:
        x, y = (p[1:-1, 2:] - p[1:-1, :-2]) / (2 * width), (p[:-2, 1:-1] - p[2:, 1:-1]) / (2 * width)
        own = ~np.isnan(p[1:-1, 1:-1])
        aspect = np.where((x != 0) | (y != 0), (np.degrees(np.arctan2(-x, -y)) + 360.0) % 360.0, np.nan)
        return [np.where(own, np.degrees(np.arctan(np.sqrt(x * x + y * y))), np.nan), aspect]

    return cells(focal(tiles(of, size), slope, ["slope", "aspect"], 1, size), {"slope": "slope", "aspect": "aspect"}, size)


def _downhill(p: np.ndarray) -> list[np.ndarray]:
    """The step (a place in STEPS) of steepest descent from each cell, -1 where no neighbour is lower, NaN without a value."""
    own, n = p[1:-1, 1:-1], p.shape[0] - 2
    drops = np.stack([(own - p[1 + r : 1 + r + n, 1 + c : 1 + c + n]) / (np.sqrt(2.0) if r and c else 1.0) for r, c in STEPS])
    drops[np.isnan(drops)] = -np.inf
    return [np.where(np.isnan(own), np.nan, np.where(drops.max(0) > 0, drops.argmax(0), -1))]


class _Flow:
    """A tile's flow: where each cell's water goes inside it, and where it leaves."""

    def __init__(self, ty: int, tx: int, steps: np.ndarray, size: int):
        at = np.arange(size * size)
        self.there = ~np.isnan(steps)
        moves = self.there & (steps >= 0)
        row, col = np.divmod(at, size) + STEPS[np.where(moves, steps, 0).astype(int)].T
        inside = (row >= 0) & (row < size) & (col >= 0) & (col < size)
        self.out = moves & ~inside
        self.next = np.where(moves & inside, row * size + col, -1)
        #: The key of the cell in another tile to which a cell's water goes next.
        self.key = ((row + ty * size) << 32) | ((col + tx * size) & 0xFFFFFFFF)
        self.own = ((at // size + ty * size) << 32) | ((at % size + tx * size) & 0xFFFFFFFF)
        edge = at % size
        self.border = self.there & ((at < size) | (at >= size * (size - 1)) | (edge == 0) | (edge == size - 1))

    def summed(self, water: np.ndarray) -> np.ndarray:
        """The water of each cell and all above it in the tile, by doubling."""
        total, to = water.copy(), self.next.copy()
        while len(i := np.flatnonzero(to >= 0)):
            more = np.zeros_like(total)
            np.add.at(more, to[i], total[i])
            total, to[i] = total + more, to[to[i]]
        return total

    def ends(self) -> np.ndarray:
        """The last cell of the tile on each cell's way."""
        to = np.where(self.next >= 0, self.next, np.arange(len(self.next)))
        while (to[to] != to).any():
            to = to[to]
        return to


def flow_accumulation(of: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, cells): from how many cells(row, col, value), itself included, water comes to each of them.

    Water goes to the neighbour of steepest descent (of eight, ties to the first in STEPS), and stays where none is
    lower: it never runs in a circle. Each tile sums its own flow; what crosses borders is a forest of border cells,
    summed by doubling in as many rounds as the most crossings of one way have binary digits; then each tile is summed
    once more with what comes in. Cells move twice, whatever the length of a river; rounds move border cells alone.
    """
    steps = table(focal(tiles(of, size), _downhill, ["steps"], 1, size), "flow")

    def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ty, tx, s in zip(*(b.column(c).to_pylist() for c in (0, 1)), b.column(2), strict=True):
                f = _Flow(ty, tx, s.values.to_numpy(zero_copy_only=False), size)
                out, border, ends = np.flatnonzero(f.out), np.flatnonzero(f.border), f.ends()
                water = f.summed(f.there.astype(np.int64))
                leaves = ends[border]
                to = pa.array(np.append(np.zeros(len(out), np.int64), f.key[leaves]), mask=np.append(np.ones(len(out), bool), ~f.out[leaves]))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(f.key[out], f.own[border])), to, pa.array(np.append(water[out], np.zeros(len(border), np.int64)))], ["at", "to", "water"])

    entries = steps.select("ty", "tx", "steps").mapInArrow(crossings, "at long, to long, water long")
    entries = table(entries.groupBy("at").agg(F.max("to").alias("to"), F.sum("water").alias("water")).where("water > 0"), "entries")
    while not entries.where("to is not null").isEmpty():
        more = entries.where("to is not null").groupBy(F.col("to").alias("at")).agg(F.sum("water").alias("more"))
        further = entries.select(F.col("at").alias("to"), F.col("to").alias("then"))
        new = entries.join(more, "at", "left").join(further, "to", "left").select("at", F.col("then").alias("to"), (F.col("water") + F.coalesce("more", F.lit(0))).alias("water"))
        before, entries = entries, table(new, "entries")
        drop(before)
    row, col = F.shiftright("at", 32), F.shiftright(F.shiftleft("at", 32), 32)
    tile = [F.floor(x / size).cast("int").alias(t) for x, t in ((row, "ty"), (col, "tx"))]
    place = (F.pmod(row, F.lit(size)) * size + F.pmod(col, F.lit(size))).cast("int")
    coming = entries.groupBy(*tile).agg(F.collect_list(F.struct(place.alias("place"), "water")).alias("coming"))  # 4 * size at most

    def flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ty, tx, s, more in zip(*(b.column(c).to_pylist() for c in (0, 1)), b.column(2), b.column(3).to_pylist(), strict=True):
                f = _Flow(ty, tx, s.values.to_numpy(zero_copy_only=False), size)
                water = f.there.astype(np.int64)
                for m in more or []:
                    water[m["place"]] += m["water"]
                total = np.where(f.there, f.summed(water), np.nan)
                yield pa.RecordBatch.from_arrays([pa.array([ty], pa.int32()), pa.array([tx], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["ty", "tx", "total"])

    full = steps.join(coming, ["ty", "tx"], "left").select("ty", "tx", "steps", "coming").mapInArrow(flooded, "ty int, tx int, total array<double>")
    return cells(full, {"total": "cells"}, size).withColumn("cells", F.col("cells").cast("long"))
