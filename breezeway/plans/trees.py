"""Fitted trees as arrays: truncated, pruned, cut to a prefix, with penalised leaves.

A fit's nodes are as many as its trees and depth allow, whatever the data, so they fit on the
driver and in every task. Rows are scored where they are, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from breezeway.session import scratch_path


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in one array each; ``roots`` are the trees' first nodes."""

    roots: np.ndarray
    feature: np.ndarray  # of the split; -1 in a leaf
    threshold: np.ndarray  # to the left up to and with it
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # mean label, also of inner nodes
    rows: np.ndarray
    depth: np.ndarray

    def leaves(self) -> np.ndarray:
        return self.feature < 0

    def truncated(self, depth: int | None = None, least_rows: int = 0) -> Trees:
        """Without the splits below ``depth`` and those of nodes with fewer than ``least_rows`` rows."""
        stop = self.rows < least_rows
        if depth is not None:
            stop = stop | (self.depth >= depth)
        return replace(self, feature=np.where(stop, -1, self.feature))

    def prefix(self, n: int) -> Trees:
        return replace(self, roots=self.roots[:n])

    def values(self, x: np.ndarray) -> np.ndarray:
        """Value of each row of ``x`` in each tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            down = np.where(x[row, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)

    def table(self) -> pd.DataFrame:
        tree = np.searchsorted(self.roots, np.arange(len(self.value)), side="right") - 1
        return pd.DataFrame({"tree": tree, "node": np.arange(len(self.value)), **{
            c: getattr(self, c) for c in ("feature", "threshold", "left", "right", "value", "rows", "depth")}})

    @staticmethod
    def of_table(nodes: pd.DataFrame) -> Trees:
        nodes = nodes.sort_values("node")
        roots = np.flatnonzero(np.diff(nodes["tree"].to_numpy(), prepend=-1))
        return Trees(roots, *(nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "rows", "depth")))


def joined(parts: list[Trees]) -> Trees:
    """All trees, one after another."""
    shift = np.cumsum([0, *[len(p.value) for p in parts]])[:-1]
    moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, shift)])
    plain = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Trees(moved("roots"), plain("feature"), plain("threshold"), moved("left"), moved("right"),
                 plain("value"), plain("rows"), plain("depth"))


def tree_of(model) -> Trees:
    """The nodes of one fitted tree with numeric features, read one by one: for the small trees of a boosting."""
    rows: list[list] = []

    def add(node, depth: int) -> int:
        at = len(rows)
        inner = node.subtreeDepth() > 0
        split = node.split() if inner else None
        rows.append([split.featureIndex() if inner else -1, split.threshold() if inner else 0.0, 0, 0,
                     node.prediction(), node.impurityStats().rawCount(), depth])
        if inner:
            rows[at][2], rows[at][3] = add(node.leftChild(), depth + 1), add(node.rightChild(), depth + 1)
        return at

    add(model._java_obj.rootNode(), 0)
    feature, threshold, left, right, value, n, depth = (np.array(c) for c in zip(*rows))
    return Trees(np.zeros(1, dtype=np.int64), feature, threshold.astype(float), left, right, value.astype(float), n, depth)


def trees_of(model, spark) -> Trees:
    """The trees of a fitted Spark tree, forest or boosting with numeric features, from its saved form."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    found = nodes.select(
        "tree", "id", "prediction", "rawCount", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas().sort_values(["tree", "id"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    tree = found["tree"].to_numpy()
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    start = roots[np.searchsorted(tree[roots], tree)]
    left, right = (found[c].to_numpy() + start for c in ("leftChild", "rightChild"))
    feature = np.where(found["leftChild"].to_numpy() >= 0, found["feature"].to_numpy(), -1)
    depth = np.zeros(len(found), dtype=np.int64)
    at = roots
    while len(at):
        inner = at[feature[at] >= 0]
        below = np.concatenate([left[inner], right[inner]])
        depth[below] = np.tile(depth[inner] + 1, 2)
        at = below
    return Trees(roots, feature, found["threshold"].fillna(0.0).to_numpy(), left, right,
                 found["prediction"].to_numpy(), found["rawCount"].to_numpy(), depth)


def penalised(tree: Trees, penalty: float, least_gain: float = 0.0) -> Trees:
    """One tree of a boosting round, with leaves of sum / (rows + penalty) and splits pruned that gain too little.

    The gain of a split is half of what sum² / (rows + penalty) of its children exceeds that of
    the node by. From the bottom up, a split of two leaves goes unless it gains more than ``least_gain``.
    """
    total = tree.value * tree.rows
    score = total * total / (tree.rows + penalty)
    feature = tree.feature.copy()
    for node in np.argsort(-tree.depth, kind="stable"):
        if feature[node] >= 0:
            a, b = tree.left[node], tree.right[node]
            if feature[a] < 0 and feature[b] < 0 and (score[a] + score[b] - score[node]) / 2 <= least_gain:
                feature[node] = -1
    return replace(tree, feature=feature, value=total / (tree.rows + penalty))


def values_of_leaves(grown: Trees, cut: Trees) -> np.ndarray:
    """For each leaf of the tree ``grown``, from left to right, its value in ``cut``, a pruning of it."""
    at = np.where(cut.leaves(), np.arange(len(cut.value)), -1)
    for node in range(len(at)):  # a node comes before those below it
        if grown.feature[node] >= 0 and at[node] >= 0:
            at[grown.left[node]] = at[grown.right[node]] = at[node]
    return cut.value[at[grown.leaves()]]


class TreeSum(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    """Predicts ``base`` plus ``weight`` times the sum of the trees' values."""

    def __init__(self, trees: Trees | None = None, base: float = 0.0, weight: float = 1.0):
        super().__init__()
        self.trees, self.base, self.weight = trees, base, weight
        self._setDefault(featuresCol="features", predictionCol="prediction")

    def scored(self, features) -> DataFrame:
        """The prediction as a column."""
        trees, base, weight = self.trees, self.base, self.weight

        @F.pandas_udf(DoubleType())
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(base + weight * trees.values(np.stack(x.to_numpy())).sum(axis=1))

        return score(vector_to_array(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self.scored(F.col(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TreeSum):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(
            self.model, path, spark, extraMetadata={"base": self.model.base, "weight": self.model.weight})
        spark.createDataFrame(self.model.trees.table()).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreeSum:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = Trees.of_table(spark.read.parquet(f"{path}/nodes").toPandas())
        model = TreeSum(nodes, metadata["base"], metadata["weight"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
