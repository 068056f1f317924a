"""Small networks trained over all rows: tasks give partial gradients, which are added up a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, table

#: Partial gradients that meet in one task of the tree, and that may come to the driver.
FAN = 64
#: Rows that are packed into one value.
PACK = 4_096
#: Steps of the resilient rule: the first one, its bounds, and the factors where a slope keeps or turns its sign.
FIRST, LEAST, MOST, KEEPS, TURNS = 0.05, 1e-6, 1.0, 1.2, 0.5


@dataclass
class Network:
    """Layers of tanh units with a linear last one; classes: its values are log-odds of classes, else numbers.

    weights holds, layer by layer, (inputs x units) and then the units' biases; inputs and, unless these are classes, outputs
    are standardised by centre and scale.
    """

    sizes: tuple[int, ...]
    classes: bool
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    out_centre: np.ndarray
    out_scale: np.ndarray

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Values of all layers, the standardised inputs first."""
        values = [(x - self.centre) / self.scale]
        layers = self.parts(self.weights)
        for n, (w, b) in enumerate(layers):
            v = values[-1] @ w + b
            values.append(v if n == len(layers) - 1 else np.tanh(v))
        return values

    def gradient(self, x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(loss, its gradient by the weights), summed over the rows: cross entropy of classes, or half the squared errors.

        A row counts as often as times says, once if it is not given.
        """
        times = np.ones(len(x)) if times is None else times
        values, grad = self.forward(x), np.zeros_like(self.weights)
        last = values[-1]
        if self.classes:
            last = last - last.max(1, keepdims=True)
            p = np.exp(last)
            p /= p.sum(1, keepdims=True)
            at = (np.arange(len(y)), y[:, 0].astype(int))
            loss = -float(times @ np.log(np.maximum(p[at], 1e-300)))
            p[at] -= 1
            back = p * times[:, None]
        else:
            back = last - (y - self.out_centre) / self.out_scale
            loss = float(times @ (back * back).sum(1) / 2)
            back *= times[:, None]
        for (w, _), (dw, db), v in zip(self.parts(self.weights)[::-1], self.parts(grad)[::-1], values[-2::-1], strict=True):
            dw += v.T @ back
            db += back.sum(0)
            back = (back @ w.T) * (1 - v * v)  # of no use at the inputs, where it ends
        return loss, grad

    def output(self, x: np.ndarray) -> np.ndarray:
        """The likeliest class, or the numbers, of each row."""
        last = self.forward(x)[-1]
        return last.argmax(1)[:, None].astype(float) if self.classes else last * self.out_scale + self.out_centre


def _packed(rows: DataFrame) -> DataFrame:
    """(packed binary): rows and how often each occurs, PACK a value; equal rows are one."""
    names = rows.columns
    once = rows.groupBy(*names).agg(F.count("*").cast("double").alias("times"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PACK):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.slice(lo, PACK).columns])
                yield pa.RecordBatch.from_pydict({"packed": pa.array([x.tobytes()], pa.binary())})

    return once.sortWithinPartitions(*names).mapInArrow(work, "packed binary")


def _sums(rows: DataFrame, net: Network, inputs: int, tasks: int) -> tuple[float, np.ndarray]:
    """(loss, gradient) over all rows, plain or packed: a row a task, then a row for FAN of those, and so on."""
    packed = rows.columns == ["packed"]
    wide = inputs + (1 if net.classes else net.sizes[-1]) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, loss, grad = None, 0.0, np.zeros_like(net.weights)
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                parts = (np.frombuffer(v.as_buffer()).reshape(-1, wide) for v in b.column(1)) if packed else [np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns[1:]), np.ones(b.num_rows)])]
                for x in parts:
                    more, slope = net.gradient(x[:, :inputs], x[:, inputs:-1], x[:, -1])
                    loss, grad = loss + more, grad + slope
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "loss": [loss], "grad": [grad.tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        got = group.sort_by("part").to_pylist()
        grad = np.sum([np.frombuffer(r["grad"]) for r in got], axis=0)
        return pa.table({"part": pa.array([got[0]["part"] // FAN], pa.int64()), "loss": [sum(r["loss"] for r in got)], "grad": [grad.tobytes()]})

    schema = "part long, loss double, grad binary"
    sums = rows.select(F.spark_partition_id().cast("long").alias("part"), "*").mapInArrow(work, schema)
    while tasks > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
    got = sorted(sums.collect())  # FAN rows at most, each as large as the weights
    return sum(r["loss"] for r in got), np.sum([np.frombuffer(r["grad"]) for r in got], axis=0)


def fit(df: DataFrame, features: list[str], targets: list[str], hidden: list[int], classes: int | None = None, rounds: int = 60, seed: int = 0, trace: list | None = None) -> Network:
    """A network from all rows of df; targets is one column of class numbers 0 to classes - 1, or columns of numbers.

    A round is one pass over the rows: each task adds up its rows' gradients and sends one row as large as the
    weights; those meet FAN by FAN until FAN are left, which the driver adds. Equal rows are reckoned once, with their number. Weights follow the resilient rule: each has a
    step of its own that grows while its slope keeps its sign and shrinks when it turns, so there is no rate to set. The rows
    are read from a table of the shared folder that has only these columns, PACK of them in a value. A row with a null or a number that is not finite
    in any of them, or with a class out of range, teaches nothing; without rows the weights stay as they were drawn. Reruns
    agree as far as the table is cut into the same tasks. trace, if given, gets the mean loss of each round.
    """
    cols = [F.col(f"`{c}`").cast("double").alias(f"c{n}") for n, c in enumerate([*features, *targets])]
    finite = [F.abs(F.col(f"c{n}")) < float("inf") for n in range(len(cols))]
    if classes:
        y = F.col(f"c{len(features)}")
        finite.append((y >= 0) & (y < classes) & (y == F.floor(y)))
    rows = df.select(*cols)
    for f in finite:
        rows = rows.where(f)
    plain = table(rows, "network")
    names = plain.columns
    rows = table(_packed(plain), "packed")
    n_in, n_out = len(features), classes or len(targets)
    last = rows.select(F.spark_partition_id().alias("task")).agg(F.coalesce(F.max("task"), F.lit(0))).first()[0]
    about = plain.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    centre = np.array([about[f"{c}_avg"] or 0.0 for c in names])
    scale = np.array([about[f"{c}_stddev_pop"] or 1.0 for c in names])
    sizes, rng = (n_in, *hidden, n_out), np.random.default_rng(seed)
    flat = np.concatenate([np.append(rng.normal(0, a**-0.5, a * b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])
    net = Network(sizes, bool(classes), flat, centre[:n_in], scale[:n_in], centre[n_in:], scale[n_in:])
    step, before = np.full_like(flat, FIRST), np.zeros_like(flat)
    best, least = flat, float("inf")
    drop(plain)
    for _ in range(rounds + 1 if about["n"] else 0):
        loss, grad = _sums(rows, net, n_in, last + 1)
        if trace is not None:
            trace.append(loss / about["n"])
        if loss < least:
            best, least = net.weights, loss
        turn = grad * before
        step = np.clip(step * np.where(turn > 0, KEEPS, np.where(turn < 0, TURNS, 1.0)), LEAST, MOST)
        before = np.where(turn < 0, 0.0, grad)  # after a turn a weight rests for a round
        net.weights = net.weights - np.sign(before) * step
    net.weights = best
    drop(rows)
    return net


def predict(net: Network, features: list[str]) -> Column:
    """A column, array<double>: the network's numbers, or its class alone; null where an input is null or not finite."""

    @F.pandas_udf("array<double>")
    def out(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(dtype=float, na_value=np.nan)
        good = np.isfinite(v).all(1)
        found = iter(net.output(v[good]).tolist() if good.any() else [])
        return pd.Series([next(found) if g else None for g in good], dtype=object)

    return out(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"c{n}") for n, c in enumerate(features)]))
