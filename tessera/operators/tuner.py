"""The tuner's decision loop: a small driver-side state machine over summaries of the trials' progress.

A trial's progress is a table (branch, k, y) that only grows; what reaches the driver is one row a live branch. Randomness
comes from a seed, time from the logical clock k, so a run can be repeated."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tunable:
    """A parameter to search: log (10^v), linear, or discrete with its values."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    values: tuple[float, ...] = ()

    def decode(self, v: float) -> float:
        if self.kind == "discrete":
            return self.values[round(v)]
        return 10**v if self.kind == "log" else v

    def grid(self, n: int) -> list[float]:
        if self.kind == "discrete":
            return list(range(len(self.values)))
        return [self.low + (self.high - self.low) * i / n for i in range(n + 1)]


def grid_search(space: list[Tunable], n: int) -> Iterator[dict[str, float]]:
    """All points, the first tunable fastest."""
    for point in product(*(t.grid(n) for t in reversed(space))):
        yield {t.name: t.decode(v) for t, v in zip(space, reversed(point), strict=True)}


def marginal_grid(space: list[Tunable], base: dict[str, float], n: int) -> Iterator[dict[str, float]]:
    """The base, then one tunable at a time, without the base's own value."""
    yield dict(base)
    for t in space:
        for v in t.grid(n):
            if t.decode(v) != base[t.name]:
                yield base | {t.name: t.decode(v)}


def random_search(space: list[Tunable], seed: int) -> Iterator[dict[str, float]]:
    rng = random.Random(seed)
    while True:
        yield {t.name: t.decode(rng.randrange(len(t.values)) if t.kind == "discrete" else rng.uniform(t.low, t.high)) for t in space}


def density_search(space: list[Tunable], seed: int, results: list[tuple[dict[str, float], float]], tries: int = 24) -> Iterator[dict[str, float]]:
    """Tree-structured Parzen estimation: of random points, that which the better results make likelier than the others."""
    points = random_search(space, seed)
    spread = {t.name: (t.high - t.low) / 4 or 1.0 for t in space}

    def near(p: dict[str, float], group: list[dict[str, float]]) -> float:
        return sum(1 / (1 + sum(((p[k] - q[k]) / spread[k]) ** 2 for k in p)) for q in group) / max(len(group), 1)

    while True:
        ranked = [p for p, _ in sorted(results, key=lambda r: r[1])]
        good, rest = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4):]
        if len(ranked) < 4:
            yield next(points)
        else:
            yield max((next(points) for _ in range(tries)), key=lambda p: near(p, good) / (near(p, rest) + 1e-9))


def slopes(progress: DataFrame) -> DataFrame:
    """One row a branch: its first and last progress, slope with the penalty of the largest rise, and state."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("branch").orderBy("k")
    rows = progress.withColumn("up", F.col("y") - F.lag("y").over(own))
    rows = rows.groupBy("branch").agg(F.count("*").alias("n"), F.min_by("y", "k").alias("y0"), F.max_by("y", "k").alias("y1"),
                                      F.greatest(F.coalesce(F.max("up"), F.lit(0.0)), F.lit(0.0)).alias("up"))
    s = (F.col("y1") - F.col("y0") + F.col("up")) / (F.col("n") - 1)
    state = F.when(F.col("y1") > 10 * F.col("y0"), "DIVERGED").when(
        F.col("up") > F.abs(F.col("y1") - F.col("y0")) * 0.5, "UNSTABLE").otherwise("CONVERGING")
    return rows.where("n > 1").select("branch", "y0", "y1", F.when(s <= 0, s).alias("slope"), state.alias("state"))


@dataclass
class Tuner:
    """Searches until a trial converges, doubling the time it gives to trials, then keeps the best slope.

    ``run``: makes progress rows for (branch, point, from clock, to clock). ``trials`` bounds the search."""

    run: Callable[[int, dict[str, float], int, int], DataFrame]
    points: Iterator[dict[str, float]]
    trials: int = 8
    clocks: int = 4
    log: list[tuple[str, int]] = field(default_factory=list)

    def search(self) -> tuple[int, dict[str, float]] | None:
        """The best branch and its point; None if the search ends without a converging trial."""
        alive: dict[int, dict[str, float]] = {}
        progress: DataFrame | None = None
        best = None
        for branch, point in zip(range(self.trials), self.points, strict=False):
            alive[branch] = point
            rows = self.run(branch, point, 0, self.clocks)
            progress = rows if progress is None else progress.unionByName(rows)
            found = {r.branch: r for r in slopes(progress).collect()}  # one row a live trial
            for b in [b for b in alive if b in found and found[b].state == "DIVERGED"]:
                self.log.append(("killed", b))
                del alive[b]
            good = [r for b, r in found.items() if b in alive and r.state == "CONVERGING" and r.slope is not None]
            if good:
                best = min(good, key=lambda r: (r.slope, r.branch))
                self.log.append(("best", best.branch))
            else:  # give the living trials as long again
                for b, p in alive.items():
                    progress = progress.unionByName(self.run(b, p, self.clocks, 2 * self.clocks))
                self.clocks *= 2
        return (best.branch, alive[best.branch]) if best is not None else None
