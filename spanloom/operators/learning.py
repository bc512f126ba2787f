"""Small learners and search. Learning is sequential by nature: it runs on a stated, bounded set of examples in one task per model; scoring is spread over the cluster."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class KernelPerceptron:
    """Online kernel classifier over sparse binary rows (L1): exp(-gamma * symmetric difference) + linear + intercept, margin updates, a budget of support rows."""

    gamma: float = 0.1
    margin: float = 1.0
    budget: int = 1_000
    rate: float = 1.0
    support: list[tuple[frozenset, float]] = field(default_factory=list)
    linear: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0
    threshold: float = 0.0

    def score(self, x: Iterable[int]) -> float:
        x = frozenset(x)
        kernel = sum(a * math.exp(-self.gamma * len(x ^ s)) for s, a in self.support)
        return kernel + sum(self.linear.get(i, 0.0) for i in x) + self.intercept

    def update(self, x: Iterable[int], y: bool) -> bool:
        """One example; whether it was within the margin and changed the model. The oldest support row leaves beyond the budget."""
        x, sign = frozenset(x), 1.0 if y else -1.0
        if sign * self.score(x) >= self.margin:
            return False
        self.support.append((x, sign * self.rate))
        if len(self.support) > self.budget:
            self.support.pop(0)
        for i in x:
            self.linear[i] = self.linear.get(i, 0.0) + sign * self.rate
        self.intercept += sign * self.rate
        return True

    def fit(self, rows: Iterable[tuple[Iterable[int], bool]]) -> KernelPerceptron:
        for x, y in rows:
            self.update(x, y)
        return self

    def tune(self, rows: Iterable[tuple[Iterable[int], bool]]) -> float:
        """The midpoint between neighbouring scores with the best accuracy."""
        scored = sorted((self.score(x), y) for x, y in rows)
        right = sum(y for _, y in scored)
        best, self.threshold = right, -math.inf
        for i, (s, y) in enumerate(scored):
            right += -1 if y else 1
            nxt = scored[i + 1][0] if i + 1 < len(scored) else math.inf
            if right > best and nxt > s:
                best, self.threshold = right, (s + nxt) / 2 if nxt < math.inf else s + 1
        return self.threshold

    def predict(self, x: Iterable[int]) -> bool:
        return self.score(x) > self.threshold


def score_rows(df: DataFrame, model: KernelPerceptron, features: str, to: str = "score") -> DataFrame:
    """df with the model's score; the model's size is bounded by its budget."""

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else model.score(int(i) for i in x) for x in xs], dtype="float64")

    return df.withColumn(to, run(F.col(features)))


def gradient_epoch(examples: DataFrame, weights: DataFrame, keys: list[str], y: str, rate: float, l2: float = 0.0) -> DataFrame:
    """feature, weight after one step of logistic regression over all examples (L3): forward a join and a sum, backward a sum per feature.

    examples: keys, feature, value, y (true or false); weights: feature, weight. Both joins are equi-joins with partial sums.
    """
    z = examples.join(weights, "feature", "left").groupBy(*keys, y).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("z"))
    error = z.select(*keys, (F.col(y).cast("double") - 1 / (1 + F.exp(-F.col("z")))).alias("error"))
    n = F.lit(float(max(error.count(), 1)))
    grad = examples.join(error, keys).groupBy("feature").agg((F.sum(F.col("value") * F.col("error")) / n).alias("g"))
    both = weights.join(grad, "feature", "full_outer")
    old = F.coalesce("weight", F.lit(0.0))
    return both.select("feature", (old + rate * (F.coalesce("g", F.lit(0.0)) - l2 * old)).alias("weight"))


def guarded(*scores: Column) -> Column:
    """The sum of scores, but an infinite one decides alone."""
    total: Column = F.lit(0.0)
    guard: Column = F.lit(None).cast("double")
    for s in scores:
        total, guard = total + s, F.coalesce(guard, F.when(F.abs(s) == float("inf"), s))
    return F.coalesce(guard, total)


def hidden_layer(x: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Score v . a with a = (1 - e^-z) / (1 + e^-z), z = w x, and its gradients for w and v, from the weights before any update (L3)."""
    a = np.tanh((w @ x) / 2)
    return float(v @ a), np.outer(v * (1 - a * a) / 2, x), a


def bilinear(y_vec: Column, x_vec: Column, theta: list[list[float]] | list[float] | float) -> Column:
    """f(y)' Theta f(x), Theta a matrix, a diagonal or a scalar."""
    if isinstance(theta, (int, float)):
        return F.lit(float(theta)) * F.aggregate(F.zip_with(y_vec, x_vec, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    if not isinstance(theta[0], (list, tuple)):
        d = F.array(*[F.lit(float(t)) for t in theta])
        return F.aggregate(F.zip_with(F.zip_with(y_vec, x_vec, lambda a, b: a * b), d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = F.array(*[F.array(*[F.lit(float(t)) for t in r]) for r in theta])
    inner = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, x_vec, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(F.zip_with(y_vec, inner, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def project_weights(theta: np.ndarray, how: str = "simplex") -> np.ndarray:
    """After an update: simplex clips to 0 and makes the sum 1; l1, l2 divide by the norm; none keeps."""
    theta = np.maximum(theta, 0) if how == "simplex" else theta
    size = {"simplex": np.abs(theta).sum(), "l1": np.abs(theta).sum(), "l2": math.sqrt(float(theta @ theta)), "none": 1.0}[how]
    return theta / size if size > 0 else theta


class Beam:
    """The best `width` items by score, the later of equals first; 0 is unbounded."""

    def __init__(self, width: int = 0):
        self.width, self._ticks, self._items = width, count(), []

    def push(self, item: Any, score: float) -> tuple[Any, float] | None:
        """What was evicted, if anything."""
        heapq.heappush(self._items, (score, next(self._ticks), item))
        if self.width > 0 and len(self._items) > self.width:
            s, _, gone = heapq.heappop(self._items)
            return gone, s
        return None

    def pop(self) -> Any:
        best = max(self._items, key=lambda x: x[:2])
        self._items.remove(best)
        heapq.heapify(self._items)
        return best[2]

    def __len__(self) -> int:
        return len(self._items)

    @property
    def max_score(self) -> float:
        return max((x[0] for x in self._items), default=-math.inf)

    @property
    def min_score(self) -> float:
        return self._items[0][0] if self._items else -math.inf

    def __iter__(self) -> Iterator[Any]:
        return (x[2] for x in sorted(self._items, key=lambda x: x[:2], reverse=True))


def best_first(start: Any, moves: Callable[[Any], Iterable[tuple[Any, float]]], width: int, keep_frontier: bool = True, max_pops: int | None = None) -> tuple[Any, float]:
    """Beam search (T12, L7): the best state popped (keeping the frontier) or the end of following the best successor only. It ends when nothing is left, or after max_pops."""
    beam = Beam(width)
    beam.push((start, 0.0), 0.0)
    best, best_score = start, 0.0 if not keep_frontier else -math.inf
    for _ in count() if max_pops is None else range(max_pops):
        if not len(beam):
            break
        state, score = beam.pop()
        successors = list(moves(state))
        if keep_frontier:
            if score > best_score or best_score == -math.inf:
                best, best_score = state, score
        else:
            best, best_score = state, score
            if successors:
                beam = Beam(width)
        for nxt, gain in successors:
            beam.push((nxt, score + gain), score + gain)
    return best, best_score


def search_groups(df: DataFrame, group: str, moves_of: Callable[[pd.DataFrame], tuple[Any, Callable]], width: int) -> DataFrame:
    """group, state, score: one search for each group of bounded size, spread over the cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, moves = moves_of(pdf)
        state, score = best_first(start, moves, width)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "state": [str(state)], "score": [float(score)]})

    return df.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, state string, score double")


def muted(score: Column, forward: bool = True) -> Column:
    """A score that is 0 while its forward pass is off (L4)."""
    return score if forward else score * 0.0


def loss_augmented(score: Column, is_gold: Column, loss: float, searching: bool = True) -> Column:
    """The score plus the loss of a wrong choice, during search only (L4)."""
    return score + F.when(is_gold, 0.0).otherwise(loss) if searching else score
