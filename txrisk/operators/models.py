"""Auxiliary classifiers: boosted trees (inference) and logistic regression on quadratic features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATURATION = 20.0


@dataclass(frozen=True)
class Node:
    """A split (``feature`` at most ``threshold`` goes left) or, with ``feature`` -1, a leaf."""

    feature: int
    threshold: float
    left: int = 0
    right: int = 0
    value: float = 0.0


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[tuple[Node, ...], ...]
    initial: float = 0.0
    sigmoid: bool = True


def sigmoid(x: Column) -> Column:
    """Saturates at 20 either way."""
    return F.when(x > SATURATION, 1.0).when(x < -SATURATION, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


#: Ensembles of more nodes are walked in numpy, since so many nested conditions do not compile.
MOST_CONDITIONS = 512


def tree_value(nodes: tuple[Node, ...], x: list[Column], at: int = 0) -> Column:
    """A tree as nested conditions."""
    n = nodes[at]
    if n.feature < 0:
        return F.lit(float(n.value)).cast("float")
    test = x[n.feature] <= F.lit(float(n.threshold)).cast("float")
    return F.when(test, tree_value(nodes, x, n.left)).otherwise(tree_value(nodes, x, n.right))


def tree_sums(model: Ensemble, x: np.ndarray) -> np.ndarray:
    """Initial value and leaves of each row's trees, summed in single precision in the order of the trees."""
    total = np.full(len(x), model.initial, np.float32)
    for nodes in model.trees:
        feature = np.array([n.feature for n in nodes])
        threshold = np.array([n.threshold for n in nodes], np.float32)
        left, right = np.array([n.left for n in nodes]), np.array([n.right for n in nodes])
        value = np.array([n.value for n in nodes], np.float32)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            f = feature[at[rows]]
            at[rows] = np.where(x[rows, f] <= threshold[at[rows]], left[at[rows]], right[at[rows]])
        total += value[at]
    return total


def ensemble_score(model: Ensemble, x: list[Column]) -> Column:
    """Score of single-precision features, in single precision throughout."""
    if sum(map(len, model.trees)) <= MOST_CONDITIONS:
        total = F.lit(float(model.initial)).cast("float")
        for t in model.trees:
            total = (total + tree_value(t, x)).cast("float")
    else:

        @F.pandas_udf("float")
        def summed(*columns: pd.Series) -> pd.Series:
            return pd.Series(tree_sums(model, np.column_stack([c.to_numpy(np.float32) for c in columns])))

        total = summed(*[c.cast("float") for c in x])
    if model.sigmoid:
        return sigmoid(total.cast("double")).cast("float")
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), total))


def quadratic(x: list[Column]) -> list[Column]:
    """The features and all products of two, the first at most the second: 14 become 119."""
    return [*x, *[x[a] * x[b] for a in range(len(x)) for b in range(a, len(x))]]


@dataclass(frozen=True)
class Logistic:
    weights: tuple[float, ...]
    bias: float = 0.0


def logistic_score(model: Logistic, x: list[Column]) -> Column:
    total = F.lit(float(model.bias))
    for w, term in zip(model.weights, quadratic(x), strict=True):
        total = total + F.lit(float(w)) * term
    return sigmoid(total)


@dataclass(frozen=True)
class Predictor:
    """A logistic model where a neighbour search is expected; without a model every score is 0."""

    model: Logistic | None = None

    def predict(self, x: list[Column]) -> Column:
        return F.lit(0.0) if self.model is None else logistic_score(self.model, x)

    def count(self) -> int:
        return 0

    def fraud_count(self) -> int:
        return 0


def train_logistic(rows: DataFrame, dims: list[str], label: str, iterations: int = 30) -> Logistic:
    """Class-weighted logistic regression on the quadratic features; one class alone has no model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        raise ValueError("both classes are needed")
    total = sum(n.values())
    terms = quadratic([F.col(d).cast("double") for d in dims])
    x = rows.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)], F.col(label).cast("double").alias("label"))
    x = x.withColumn("w", F.when(F.col("label") == 1, total / (2.0 * n[True])).otherwise(total / (2.0 * n[False])))
    x = VectorAssembler(inputCols=[f"t{i}" for i in range(len(terms))], outputCol="features").transform(x)
    fit = LogisticRegression(weightCol="w", maxIter=iterations).fit(x.select("features", "label", "w"))
    return Logistic(tuple(map(float, fit.coefficients)), float(fit.intercept))


def confusion(rows: DataFrame, score: Column, label: Column, least: float = 0.5) -> DataFrame:
    """(tp, tn, fp, fn) at a decision threshold."""
    p, y = F.col("p"), F.col("y")
    count = lambda c, name: F.count_if(c).alias(name)
    judged = rows.select(F.coalesce(score >= least, F.lit(False)).alias("p"), label.alias("y"))
    return judged.agg(count(p & y, "tp"), count(~p & ~y, "tn"), count(p & ~y, "fp"), count(~p & y, "fn"))
