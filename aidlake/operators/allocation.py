"""Relief-supply allocation by a genetic algorithm on islands; objective and rules are this library's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, table

#: Pairs of a demand and a depot that an island holds.
LARGEST = 1_000_000


def allocate(costs: DataFrame, islands: int = 8, generations: int = 20, size: int = 40, rounds: int = 3, seed: int = 0) -> DataFrame:
    """(island, cost, assignment): the best depot for each demand (in order) found on each island.

    costs(demand, depot, cost, load, capacity) has a row for each pair; it is sent to the islands as rows, by Spark.
    Overload is fined ten times the mean cost. After each round of generations the best quarter of an island's people
    goes on to the next island, so good solutions spread. A problem of over LARGEST pairs is refused: an island holds it.
    """
    if costs.count() > LARGEST:
        raise ValueError("the problem is too large to be held by an island")
    spark = costs.sparkSession
    sent = spark.range(islands).select(F.col("id").alias("island")).crossJoin(costs.select("demand", "depot", "cost", "load", "capacity"))  # islands times a bounded table
    people = spark.createDataFrame([], "island long, fine double, assignment array<int>")

    def evolve(turn: int, last: bool):
        def work(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({"island": [], "fine": [], "assignment": []})
            island, r = int(key[0]), np.random.default_rng([seed, int(key[0]), turn])
            grid = pdf.pivot(index="demand", columns="depot", values="cost").sort_index().sort_index(axis=1)
            cost = grid.to_numpy()
            load, room = pdf.groupby("demand").load.first().loc[grid.index].to_numpy(), pdf.groupby("depot").capacity.first().loc[grid.columns].to_numpy()
            n, m = cost.shape
            folk = r.integers(m, size=(size, n))
            own = sorted(zip(before.fine, map(tuple, before.assignment), strict=True))  # whatever order the rows came in
            for k, (_, a) in enumerate(own[:size]):
                folk[k] = a

            def fitness(p):
                used = np.zeros((len(p), m))
                np.add.at(used, (np.arange(len(p))[:, None], p), load[None])
                return cost[np.arange(n), p].sum(1) + 10 * cost.mean() * np.maximum(0, used - room).sum(1)

            for _ in range(generations):
                best = folk[np.argsort(fitness(folk), kind="stable")[: max(1, size // 4)]]
                a, b = (best[r.integers(len(best), size=size)] for _ in "ab")
                folk = np.where(r.random(a.shape) < 0.5, a, b)
                flips = r.random(folk.shape) < 1 / n
                folk[flips] = r.integers(m, size=int(flips.sum()))
                folk[0] = best[0]
            f = fitness(folk)
            order = np.argsort(f, kind="stable")
            if last:
                return pd.DataFrame({"island": [island], "cost": [float(f[order[0]])], "assignment": [grid.columns.to_numpy()[folk[order[0]]].tolist()]})
            go, stay = order[: max(1, size // 4)], order[: max(1, size // 2)]
            to = [(island + 1) % islands] * len(go) + [island] * len(stay)
            return pd.DataFrame({"island": to, "fine": np.append(f[go], f[stay]), "assignment": [folk[k].tolist() for k in np.append(go, stay)]})

        return work

    for turn in range(rounds):
        last = turn == rounds - 1
        pairs = sent.groupBy("island").cogroup(people.groupBy("island"))
        if last:
            return pairs.applyInPandas(evolve(turn, last), "island long, cost double, assignment array<long>")
        before, people = people, table(pairs.applyInPandas(evolve(turn, last), "island long, fine double, assignment array<int>"), "people")
        if turn:
            drop(before)
