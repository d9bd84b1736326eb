"""A perceptron with one hidden layer, learned for all folds at once from sums that Spark takes over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ablation import Folds, by_folds
from fieldloom.operators.rounds import settled

# Hidden places, penalty, share held out (one of so many rows), rounds without a better score, and by how much better.
HIDDEN, ALPHA, HELD, PATIENCE, BETTER = 16, 1e-3, 10, 10, 1e-4
#: Passes over the rows, and how many earlier steps tell the curvature.
MOST, MEMORY = 200, 10


def split(w: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The weights into and out of the hidden places, each with its constants."""
    inner = w[: (d + 1) * HIDDEN].reshape(d + 1, HIDDEN)
    return inner[:d], inner[d], w[(d + 1) * HIDDEN : -1], w[-1]


def starting(d: int, seed: int) -> np.ndarray:
    """Uniform weights by the number of places on both sides of a layer."""
    rng = np.random.default_rng(seed)
    first, second = (6 / (d + HIDDEN)) ** 0.5, (2 / (HIDDEN + 1)) ** 0.5
    return np.concatenate([rng.uniform(-first, first, (d + 1) * HIDDEN), rng.uniform(-second, second, HIDDEN + 1)])


def scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    inner, bias, out, constant = split(w, x.shape[1])
    return np.maximum(x @ inner + bias, 0) @ out + constant


def loss_and_slope(w: np.ndarray, x: np.ndarray, c: int, times: np.ndarray) -> np.ndarray:
    """The summed loss of rows of class c, each so many times, and its gradient."""
    inner, bias, out, constant = split(w, x.shape[1])
    a = np.maximum(x @ inner + bias, 0)
    s = a @ out + constant
    e = (1 / (1 + np.exp(-np.clip(s, -60, 60))) - c) * times
    back = np.outer(e, out) * (a > 0)
    return np.concatenate([[((np.logaddexp(0, s) - c * s) * times).sum()], (x.T @ back).ravel(), back.sum(axis=0), a.T @ e, [e.sum()]])


def dealt(given: Folds) -> DataFrame:
    """The different rows, with how many of each are learned from and how many are held out: of m equal ones m / HELD,
    rounded up or down by a hash, so that repeated rows are on both sides."""
    each = given.rows.groupBy("fold", "y", "x").agg(F.count(F.lit(1)).alias("m"))
    held = F.floor((F.col("m") + F.pmod(F.xxhash64("fold", "y", "x"), F.lit(HELD))) / HELD)
    return settled(each.select("fold", "y", "x", (F.col("m") - held).alias("learned"), held.alias("held")))


def _sums(given: Folds, rows: DataFrame, tried: np.ndarray) -> np.ndarray:
    """By fold and class, over the other folds' rows: how many are learned from, their loss and its gradient; how many
    are held out, and how many of those are told rightly. A class of fewer than 2 * HELD rows holds none out. Each task
    adds its rows up, Spark the tasks' sums."""
    n, size = len(given.names), tried.shape[1]
    own = replace(given, rows=None)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n, 2, size + 4))
        for batch in batches:
            x, y, fold = np.array(batch["x"].tolist(), float).reshape(len(batch), own.scale.shape[2]), batch["y"].to_numpy(), batch["fold"].to_numpy()
            learned, held = batch["learned"].to_numpy(), batch["held"].to_numpy()
            for k, name in enumerate(own.names):
                for c in (0, 1):
                    mine = (fold != name) & (y == c)
                    z, kept = (x[mine] - own.scale[k, 0]) / own.scale[k, 1], held[mine] * (own.counts[k, c] >= 2 * HELD)
                    times = learned[mine] + held[mine] - kept
                    right = kept[(scores(tried[k], z) >= 0) == c].sum()
                    sums[k, c] += np.concatenate([[times.sum()], loss_and_slope(tried[k], z, c, times), [kept.sum(), right]])
        yield pd.DataFrame({"k": range(n), "sums": list(sums.reshape(n, -1))})

    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(add, "k int, sums array<double>")
    out = np.zeros((n, 2 * (size + 4)))
    for r in few.select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[r.k, r.i] = r.v
    return out.reshape(n, 2, size + 4)


@dataclass
class _Descent:
    """One fold's descent: where it is, the best weights so far, and the last steps with their changes of slope."""

    at: np.ndarray
    loss: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    size: float = 1.0
    best: np.ndarray | None = None
    score: float = -np.inf
    waited: int = 0
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def tried(self) -> np.ndarray:
        return self.at if self.way is None else self.at + self.size * self.way

    def direction(self) -> np.ndarray:
        """Down the slope, bent by the curvature that the last steps tell (limited-memory BFGS)."""
        q, used = self.slope.copy(), []
        for step, change in reversed(self.steps):
            share = step @ q / (step @ change)
            q -= share * change
            used.append(share)
        if self.steps:
            step, change = self.steps[-1]
            q *= step @ change / (change @ change)
        else:
            q *= min(1.0, 1 / max(np.linalg.norm(q), 1e-12))
        for (step, change), share in zip(self.steps, reversed(used), strict=True):
            q += step * (share - change @ q / (step @ change))
        return -q

    def told(self, loss: float, slope: np.ndarray, score: float) -> None:
        """Takes the step if it went down far enough, else halves it. Done when the score hasn't got better for
        PATIENCE steps, or there is no way down."""
        if self.way is not None and not loss <= self.loss + 1e-4 * self.size * (self.slope @ self.way):
            self.size /= 2
            self.done = self.size < 1e-6
            return
        if self.way is not None:
            step, change = self.size * self.way, slope - self.slope
            if step @ change > 1e-10:
                self.steps = [*self.steps, (step, change)][-MEMORY:]
        self.at, self.loss, self.slope, self.size = self.tried(), loss, slope, 1.0
        self.waited = 0 if score > self.score + BETTER else self.waited + 1
        if score > self.score + BETTER or self.best is None:
            self.best, self.score = self.at, score
        self.way = self.direction()
        self.done = self.waited >= PATIENCE or np.abs(slope).max() < 1e-6


def learned(given: Folds, seed: int = 1000, most: int = MOST) -> np.ndarray:
    """By fold the weights that told the held-out rows best, balanced by class; where none are held out, those of the
    smallest loss. The loss is the mean over both classes of a row's, with the penalty on all weights but constants. How rows
    are dealt to tasks changes nothing but roundings. Each round is one pass over the rows for all folds; a fold whose others lack a class always
    says the other."""
    d = given.scale.shape[2]
    w = np.zeros((len(given.names), (d + 2) * HIDDEN + 1))
    spared = np.concatenate([np.ones(d * HIDDEN), np.zeros(HIDDEN), np.ones(HIDDEN), [0.0]])
    w[:, -1] = np.where(given.counts[:, 1] > 0, 60.0, -60.0)
    folds = {k: _Descent(starting(d, seed + k)) for k in range(len(w)) if given.counts[k].min() > 0}
    rows = dealt(given) if folds else given.rows
    for _ in range(most):
        left = {k: x for k, x in folds.items() if not x.done}
        if not left:
            break
        tried = w.copy()
        for k, x in left.items():
            tried[k] = x.tried()
        sums = _sums(given, rows, tried)
        for k, x in left.items():
            n, kept, right = sums[k, :, 0], sums[k, :, -2], sums[k, :, -1]
            mean = (sums[k, :, 1:-2] / (2 * np.maximum(n, 1))[:, None]).sum(axis=0)
            penalty = ALPHA / max(n.sum(), 1) * spared * tried[k]
            loss = mean[0] + 0.5 * (penalty * tried[k]).sum()
            x.told(loss, mean[1:] + penalty, (right[kept > 0] / kept[kept > 0]).mean() if kept.any() else -loss)
    for k, x in folds.items():
        w[k] = x.best
    return w


def perceptron_predictions(df: DataFrame, features: Sequence[str], target: str = "y", fold: str = "fold", seed: int = 1000) -> DataFrame:
    """(fold, y, y_pred) of every row, by a perceptron that learned from the other folds' rows, whatever their number; folds
    are few. Features are standardised by the training rows, missing ones are 0; rows without a target or fold are left
    out, and one fold alone, or an empty table, gives no rows."""
    given = by_folds(df, features, target, fold)
    if len(given.names) < 2:
        return df.sparkSession.createDataFrame([], "fold int, y int, y_pred int")
    w, own = learned(given, seed), replace(given, rows=None)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k, x = own.scaled(batch)
            told = np.zeros(len(batch), "int32")
            for one in np.unique(k):
                told[k == one] = scores(w[one], x[k == one]) >= 0
            yield pd.DataFrame({"fold": batch["fold"], "y": batch["y"], "y_pred": told})

    return given.rows.mapInPandas(predict, "fold int, y int, y_pred int")
