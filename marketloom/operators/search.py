"""Sequential search of parameters by a tree-structured Parzen estimator.

Trials are split into the good ones and the rest. Each parameter has a density over the values of either side:
kernels of a width that fits their spacing, with one wide kernel for the whole range. The next point is, of
several drawn from the good side's density, the one where that density is highest over the other's. A trial is
a Spark job of its own; only parameters and losses, a row a trial, are on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trials that are drawn at random first; draws from the good side for a suggestion; the good side has SHARE * sqrt(trials) of them, MOST_GOOD at most.
STARTUP, DRAWS, SHARE, MOST_GOOD = 12, 24, 1.0, 25
#: How often a suggestion is drawn at random all the same, so that a value that no good trial has is tried again.
EXPLORE = 0.1


@dataclass(frozen=True)
class Uniform:
    """A number between lo and hi; log: even over its logarithm."""

    lo: float
    hi: float
    log: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else x

    def outer(self, u: float) -> float:
        return min(self.hi, max(self.lo, math.exp(u) if self.log else u))

    def draw(self, rng: np.random.Generator):
        return self.outer(rng.uniform(self.inner(self.lo), self.inner(self.hi)))

    def _kernels(self, seen: list) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths: of the whole range, and of each value, as wide as the gap to its farther neighbour."""
        lo, hi = self.inner(self.lo), self.inner(self.hi)
        u = np.sort([self.inner(x) for x in seen])
        edges = np.concatenate([[lo], u, [hi]])
        gaps = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        least = (hi - lo) / min(100, 1 + len(u))
        return np.concatenate([[(lo + hi) / 2], u]), np.concatenate([[hi - lo], np.clip(gaps, least, hi - lo)])

    def draw_near(self, seen: list, rng: np.random.Generator):
        centres, widths = self._kernels(seen)
        k, lo, hi = rng.integers(len(centres)), self.inner(self.lo), self.inner(self.hi)
        while True:
            u = rng.normal(centres[k], widths[k])
            if lo <= u <= hi:
                return self.outer(u)

    def log_density(self, seen: list, x) -> float:
        centres, widths = self._kernels(seen)
        lo, hi = self.inner(self.lo), self.inner(self.hi)
        cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
        inside = cdf((hi - centres) / widths) - cdf((lo - centres) / widths)
        z = (self.inner(x) - centres) / widths
        return float(np.log(np.mean(np.exp(-z * z / 2) / (widths * inside)) + 1e-300))


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[rng.integers(len(self.values))]

    def _weights(self, seen: list) -> np.ndarray:
        counts = np.array([1.0 + sum(x == v for x in seen) for v in self.values])
        return counts / counts.sum()

    def draw_near(self, seen: list, rng: np.random.Generator):
        return self.values[rng.choice(len(self.values), p=self._weights(seen))]

    def log_density(self, seen: list, x) -> float:
        return float(np.log(self._weights(seen)[self.values.index(x)]))


Space = dict[str, Uniform | Choice]
Trial = tuple[dict, float]


def suggest(trials: list[Trial], space: Space, rng: np.random.Generator) -> dict:
    """The next parameters to try, by the losses so far; a loss that is not a number counts as the worst."""
    if len(trials) < STARTUP or rng.random() < EXPLORE:
        return {name: axis.draw(rng) for name, axis in space.items()}
    ordered = sorted(trials, key=lambda t: (math.inf if math.isnan(t[1]) else t[1]))
    n = min(MOST_GOOD, max(1, math.ceil(SHARE * math.sqrt(len(trials)))))
    good, rest = ordered[:n], ordered[n:]
    out = {}
    for name, axis in space.items():
        near, far = [p[name] for p, _ in good], [p[name] for p, _ in rest]
        drawn = [axis.draw_near(near, rng) for _ in range(DRAWS)]
        out[name] = max(drawn, key=lambda x: axis.log_density(near, x) - axis.log_density(far, x))
    return out


def minimise(loss: Callable[[dict], float], space: Space, evaluations: int = 50, seed: int = 0, together: int = 1) -> list[Trial]:
    """All trials in order. `together` suggestions are evaluated at a time, in driver threads, each from the trials before: the same seed gives the same trials."""
    rng, trials = np.random.default_rng(seed), []
    with ThreadPoolExecutor(together) as pool:
        while len(trials) < evaluations:
            some = [suggest(trials, space, rng) for _ in range(min(together, evaluations - len(trials)))]
            trials += zip(some, pool.map(loss, some))
    return trials


def trial_log(spark: SparkSession, trials: list[Trial], space: Space) -> DataFrame:
    """(trial, loss, best, parameters...): a row a trial; best marks the first of the least loss. Choices are as their values' text."""
    kinds = {n: "double" if isinstance(a, Uniform) else "string" for n, a in space.items()}
    least = min((i for i, t in enumerate(trials) if not math.isnan(t[1])), key=lambda i: (trials[i][1], i), default=-1)
    rows = [(i, float(loss), i == least, *(float(p[n]) if k == "double" else str(p[n]) for n, k in kinds.items())) for i, (p, loss) in enumerate(trials)]
    return spark.createDataFrame(rows, ", ".join(["trial int", "loss double", "best boolean", *(f"{n} {k}" for n, k in kinds.items())])).orderBy(F.col("loss"), "trial")


def save_parameters(found: DataFrame, path: str) -> None:
    """Keep found(pair, and a column for each parameter) as JSON text, a folder a pair; a pair's older parameters go."""
    text = F.to_json(F.struct(*[c for c in found.columns if c != "pair"]))
    found.select(text.alias("value"), "pair").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair").text(path)


def load_parameters(spark: SparkSession, path: str, pair: str) -> dict:
    """The kept parameters of a pair; none where there are none or the text can't be read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    row = spark.read.schema("value string, pair string").text(path).filter(F.col("pair") == pair).first()
    try:
        kept = json.loads(row["value"]) if row else {}
    except ValueError:
        return {}
    return kept if isinstance(kept, dict) else {}
