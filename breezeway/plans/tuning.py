"""Grid searches that read many grid points off one fit, and boosting with penalised leaves.

Folds are dealt by a hash of the row, once for all points. Of a forest, a point with fewer
trees is a prefix, one with a smaller depth a truncation, one with a limit on the rows of a
split a pruning of larger fits: 32 points take 4 fits a fold. Of a boosting, fewer rounds are a
prefix: 32 points take 16 fits a fold. All points of a fit are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeway.plans.trees import Trees, TreeSum, joined, penalised, tree_of, trees_of, values_of_leaves
from breezeway.session import discard, materialise

SEED = 42

#: Rounds whose sums are held by the executors alone; after so many they are written.
ROUNDS_BETWEEN_WRITES = 10
#: Training rows of a task: the least worth one, and, once all cores have theirs, the most. A fit of trees sends the
#: statistics of every open node from each task, so tasks must follow from the rows, not from how the input was split.
ROWS_OF_A_TASK = (10_000, 100_000)

BOOSTING_GRID = {
    "maxIter": [200, 250], "maxDepth": [7, 9], "stepSize": [0.08, 0.1],
    "minInstancesPerNode": [2, 5], "subsamplingRate": [0.9, 1.0],
}
FOREST_GRID = {
    "numTrees": [150, 200], "maxDepth": [12, 15], "minRowsToSplit": [2, 5],
    "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2"],
}

Point = dict[str, object]


def points_of(grid: dict[str, list]) -> list[Point]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def with_folds(train: DataFrame, folds: int) -> DataFrame:
    """``fold`` by a hash of features and label; equal rows share a fold."""
    return train.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), vector_to_array("features"), "label"), F.lit(folds)))


def laid_out(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to tasks by their number (``ROWS_OF_A_TASK``), whatever they came from."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    few, many = (-(-n // size) for size in reversed(ROWS_OF_A_TASK))
    return rows.repartition(max(1, few, min(many, cores)))


def r2_of(rows: float, y: float, yy: float, squares: float) -> float:
    """R2 from the sums of rows, labels, squared labels and squared errors."""
    spread = yy - y * y / rows
    return 1.0 - squares / spread if spread > 0 else float(squares == 0)


def forest_errors(rows: DataFrame, trees: Trees, points: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], float]:
    """R2 on ``rows`` of each (trees, depth, least rows of a split), read off ``trees`` in one pass."""
    shapes = sorted({p[1:] for p in points})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(points), 4))
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch["x"].to_numpy()), batch["label"].to_numpy()
            for depth, least in shapes:
                values = trees.truncated(depth, least).values(x)
                for i, (n, *shape) in enumerate(points):
                    if tuple(shape) == (depth, least):
                        error = values[:, :n].mean(axis=1) - y
                        sums[i] += [len(y), y.sum(), y @ y, error @ error]
        yield pd.DataFrame({"point": np.arange(len(points)), **dict(zip(["rows", "y", "yy", "squares"], sums.T))})

    found = rows.select(vector_to_array("features").alias("x"), "label").mapInPandas(
        run, "point long, rows double, y double, yy double, squares double")
    total = found.groupBy("point").agg(*[F.sum(c).alias(c) for c in ("rows", "y", "yy", "squares")])
    return {points[r.point]: r2_of(r.rows, r.y, r.yy, r.squares) for r in total.collect() if r.rows}


def boosting_errors(rows: DataFrame, model, rounds: list[int]) -> dict[int, float]:
    """R2 on ``rows`` after each number of ``rounds`` of a fitted boosting, in one pass."""
    s = rows.agg(F.count("label").alias("n"), F.sum("label").alias("y"), F.sum(F.col("label") * F.col("label")).alias("yy")).first()
    mean_squares = model.evaluateEachIteration(rows, "squared")
    return {n: r2_of(s.n, s.y, s.yy, mean_squares[n - 1] * s.n) for n in rounds} if s.n else {}


@dataclass
class Scored:
    point: Point
    by_fold: list[float]

    @property
    def mean(self) -> float:
        return float(np.mean(self.by_fold))


class Searched(Model):
    """The best point's model, fitted on all rows, and the scores of all points."""

    def __init__(self, best: Model, scores: list[Scored]):
        super().__init__()
        self.bestModel, self.scores = best, scores

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.bestModel.transform(dataset)


def _prefixes(grid: dict[str, list], shared: tuple[str, ...]) -> list[Point]:
    """The points that need a fit of their own: all but the ``shared`` settings."""
    return points_of({k: v for k, v in grid.items() if k not in shared})


class GridSearch(Estimator):
    """Cross-validated search by mean R2; ``fit_points`` scores all points of one fit on one fold."""

    def __init__(self, grid: dict[str, list], shared: tuple[str, ...], fit_points: Callable, fit_best: Callable,
                 folds: int = 3, parallelism: int = 4):
        super().__init__()
        self.grid, self.shared, self.fit_points, self.fit_best = grid, shared, fit_points, fit_best
        self.folds, self.parallelism = folds, parallelism

    def _fit(self, dataset: DataFrame) -> Searched:
        rows = materialise(laid_out(with_folds(dataset.select("features", "label"), self.folds)), "folds")
        jobs = [(k, p) for k in range(self.folds) for p in _prefixes(self.grid, self.shared)]

        def one(job) -> list[tuple[Point, float]]:
            fold, point = job
            train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            return self.fit_points(train, test, point, {k: self.grid[k] for k in self.shared if k in self.grid})

        with ThreadPoolExecutor(self.parallelism) as pool:
            found = [scored for part in pool.map(one, jobs) for scored in part]
        points = points_of(self.grid)
        scores = [Scored(p, [r2 for q, r2 in found if q == p]) for p in points]
        best = max(scores, key=lambda s: s.mean)  # the first of equal ones
        model = self.fit_best(rows.drop("fold"), best.point)
        discard(rows)
        return Searched(model, scores)


def _forest(point: Point, trees: int, depth: int) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=point.get("minInstancesPerNode", 1),
        featureSubsetStrategy=point.get("featureSubsetStrategy", "all"), seed=SEED)


def forest_search(grid: dict[str, list] = FOREST_GRID, folds: int = 3, parallelism: int = 4) -> GridSearch:
    """Forests: ``numTrees``, ``maxDepth`` and ``minRowsToSplit`` are read off one fit of the largest.

    A node of fewer than ``minRowsToSplit`` rows (counted as the tree drew them) is not split.
    """
    defaults = {"numTrees": [100], "maxDepth": [10], "minRowsToSplit": [2]}

    def fit_points(train, test, point, shared):
        n, depth, least = ({**defaults, **shared}[k] for k in defaults)
        trees = trees_of(_forest(point, max(n), max(depth)).fit(train), train.sparkSession)
        errors = forest_errors(test, trees, list(product(n, depth, least)))
        named = lambda p: {k: v for k, v in zip(defaults, p) if k in shared}
        return [({**point, **named(p)}, r2) for p, r2 in errors.items()]

    def fit_best(train, point):
        n, depth, least = (point.get(k, defaults[k][0]) for k in defaults)
        trees = trees_of(_forest(point, n, depth).fit(train), train.sparkSession)
        return TreeSum(trees.truncated(depth, least), 0.0, 1.0 / n)

    return GridSearch(grid, ("numTrees", "maxDepth", "minRowsToSplit"), fit_points, fit_best, folds, parallelism)


def boosting_search(grid: dict[str, list] = BOOSTING_GRID, folds: int = 3, parallelism: int = 4) -> GridSearch:
    """Boosting: numbers of rounds (``maxIter``) are read off one fit of the largest."""
    def fit_points(train, test, point, shared):
        rounds = shared.get("maxIter", [20])
        model = GBTRegressor(maxIter=max(rounds), seed=SEED, **point).fit(train)
        named = lambda n: {"maxIter": n} if "maxIter" in shared else {}
        return [({**point, **named(n)}, r2) for n, r2 in boosting_errors(test, model, rounds).items()]

    return GridSearch(grid, ("maxIter",), fit_points, lambda train, point: GBTRegressor(seed=SEED, **point).fit(train),
                      folds, parallelism)


class PenalisedBoosting(Estimator):
    """Boosted trees with penalised leaves and pruned splits.

    Starts from the mean label. Each round fits a tree to the residuals; its leaves become
    sum of residuals / (rows + ``penalty``), and splits that gain no more than ``least_gain`` under that
    penalty are pruned from the bottom up. Trees add ``rate`` times their value.
    """

    def __init__(self, rounds: int = 100, depth: int = 6, rate: float = 0.3, penalty: float = 1.0, least_gain: float = 0.0):
        super().__init__()
        self.rounds, self.depth, self.rate, self.penalty, self.least_gain = rounds, depth, rate, penalty, least_gain

    def _fit(self, dataset: DataFrame) -> TreeSum:
        base = float(dataset.agg(F.avg("label")).first()[0] or 0.0)
        written = materialise(laid_out(dataset.select("features", "label", F.lit(base).alias("margin"))), "boosting")
        grower = DecisionTreeRegressor(labelCol="residual", maxDepth=self.depth, leafCol="leaf", seed=SEED)
        before, rows, kept = None, written.persist(), []
        for n in range(1, self.rounds + 1):
            fitted = grower.fit(rows.select("features", (F.col("label") - F.col("margin")).alias("residual")))
            if before:
                before.unpersist()
            grown = tree_of(fitted)
            kept.append(penalised(grown, self.penalty, self.least_gain))
            values = F.array(*[F.lit(self.rate * float(v)) for v in values_of_leaves(grown, kept[-1])])
            added = fitted.setPredictionCol("").transform(rows).select(
                "features", "label", (F.col("margin") + F.get(values, F.col("leaf").cast("int"))).alias("margin"))
            if n % ROUNDS_BETWEEN_WRITES == 0:
                after = materialise(added, "boosting")
                rows.unpersist()
                discard(written)
                before, written, rows = None, after, after.persist()
            else:
                before, rows = rows, added.persist()
        for held in filter(None, (before, rows)):
            held.unpersist()
        discard(written)
        return TreeSum(joined(kept), base, self.rate)
