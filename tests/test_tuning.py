"""Grid points read off larger fits, penalised leaves, exact splits, and what trainers record."""

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from breezeway.plans import training, tuning
from breezeway.plans.trees import Trees, TreeSum, joined, penalised, tree_of, trees_of


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).round(3)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=400) * 0.1
    rows = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"])
    return rows.repartition(2).cache(), x, y


def test_truncations_equal_direct_fits(spark, data):
    """Without random choices a smaller depth gives the same tree, and so does a limit on the rows of a split."""
    rows, x, _ = data
    deep = trees_of(DecisionTreeRegressor(maxDepth=9, seed=1).fit(rows), spark)
    for depth in (1, 3, 6):
        direct = trees_of(DecisionTreeRegressor(maxDepth=depth, seed=1).fit(rows), spark)
        np.testing.assert_allclose(deep.truncated(depth).values(x), direct.values(x), atol=1e-12)
    pruned = deep.truncated(least_rows=40)
    inner = np.flatnonzero(pruned.feature >= 0)
    assert len(inner) and pruned.rows[inner].min() >= 40
    # a node of 40 rows or more is split as in the whole tree
    assert set(inner) == set(np.flatnonzero((deep.feature >= 0) & (deep.rows >= 40)))


def test_arrays_predict_as_the_fitted_models_do(spark, data):
    rows, x, _ = data
    forest = RandomForestRegressor(numTrees=7, maxDepth=6, featureSubsetStrategy="sqrt", seed=3).fit(rows)
    want = np.array([r.prediction for r in forest.transform(rows).collect()])
    got = np.array([r.prediction for r in TreeSum(trees_of(forest, spark), 0.0, 1 / 7).transform(rows).collect()])
    np.testing.assert_allclose(got, want, atol=1e-12)
    one = DecisionTreeRegressor(maxDepth=4).fit(rows)
    a, b = tree_of(one), trees_of(one, spark)
    np.testing.assert_allclose(a.values(x), b.values(x), atol=1e-12)
    assert sorted(a.rows[a.feature < 0]) == sorted(b.rows[b.feature < 0])


def test_forest_points_of_one_fit(spark, data):
    """Scores of all points equal those of the prefix, truncated and pruned, worked out row by row."""
    rows, x, y = data
    trees = trees_of(RandomForestRegressor(numTrees=6, maxDepth=7, featureSubsetStrategy="sqrt", seed=3).fit(rows), spark)
    points = [(n, d, s) for n in (2, 6) for d in (3, 7) for s in (2, 30)]
    got = tuning.forest_errors(rows, trees, points)
    for n, d, s in points:
        p = trees.truncated(d, s).prefix(n).values(x).mean(axis=1)
        assert got[n, d, s] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_boosting_rounds_are_prefixes(data):
    rows, _, y = data
    long = GBTRegressor(maxIter=6, maxDepth=3, seed=tuning.SEED).fit(rows)
    got = tuning.boosting_errors(rows, long, [2, 6])
    for n in (2, 6):
        model = GBTRegressor(maxIter=n, maxDepth=3, seed=tuning.SEED).fit(rows)
        sse = model.transform(rows).agg(F.sum((F.col("label") - F.col("prediction")) ** 2)).first()[0]
        assert got[n] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_searches_score_every_point_on_every_fold(data):
    rows = data[0]
    grid = {"numTrees": [2, 4], "maxDepth": [2, 5], "minRowsToSplit": [2, 50], "featureSubsetStrategy": ["all", "sqrt"]}
    model = tuning.forest_search(grid, folds=2).fit(rows)
    assert len(model.scores) == 16 and all(len(s.by_fold) == 2 for s in model.scores)
    assert model.transform(rows).where("prediction IS NULL").isEmpty()
    assert max(s.mean for s in model.scores) > 0.5
    boosted = tuning.boosting_search({"maxIter": [2, 5], "maxDepth": [2, 3]}, folds=2).fit(rows)
    assert len(boosted.scores) == 4 and all(len(s.by_fold) == 2 for s in boosted.scores)
    assert len(tuning.points_of(tuning.FOREST_GRID)) == len(tuning.points_of(tuning.BOOSTING_GRID)) == 32


def test_penalised_leaves_equal_sums_over_rows(data):
    """Every round's leaves are sum of residuals / (rows + penalty) of the rows that fall into them."""
    rows, x, y = data
    model = tuning.PenalisedBoosting(rounds=13, depth=3, rate=0.3, penalty=2.0, least_gain=0.01).fit(rows)
    margin = np.full(len(y), y.mean())
    ends = np.append(model.trees.roots, len(model.trees.value))
    for a, b in zip(ends, ends[1:]):
        part = slice(a, b)
        tree = Trees(np.zeros(1, dtype=int), *(getattr(model.trees, c)[part] - (a if c in ("left", "right") else 0)
                                               for c in ("feature", "threshold", "left", "right", "value", "rows", "depth")))
        labelled = Trees(tree.roots, tree.feature, tree.threshold, tree.left, tree.right, np.arange(b - a).astype(float), tree.rows, tree.depth)
        leaf = labelled.values(x)[:, 0].astype(int)
        for node in set(leaf):
            inside = leaf == node
            assert tree.value[node] == pytest.approx((y - margin)[inside].sum() / (inside.sum() + 2.0), abs=1e-9)
        margin = margin + 0.3 * tree.values(x)[:, 0]
    got = [r.prediction for r in model.transform(rows).collect()]
    assert np.sort(got) == pytest.approx(np.sort(margin), abs=1e-9)


def test_rounds_need_no_python_and_few_rows_are_one_task(data, monkeypatch):
    """Sums of the rounds are kept by the trees' leaves, and equal what the model predicts."""
    rows, x, _ = data
    written, write = [], tuning.materialise

    def spy(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, label)
        got = sorted((tuple(r.features.toArray()), r.margin) for r in out.collect())
        written.append(("Python" in plan, df.rdd.getNumPartitions(), got))
        return out

    monkeypatch.setattr(tuning, "materialise", spy)
    model = tuning.PenalisedBoosting(rounds=11, depth=4, rate=0.3, penalty=2.0, least_gain=0.05).fit(rows.repartition(7))
    assert [(python, tasks) for python, tasks, _ in written] == [(False, 1), (False, 1)]
    features, margins = zip(*written[1][2])
    want = model.base + 0.3 * model.trees.prefix(10).values(np.array(features)).sum(axis=1)
    np.testing.assert_allclose(margins, want, atol=1e-9)


def tasks_of(monkeypatch, module, label):
    """Tasks by which ``module`` writes its tables of this label."""
    found, write = [], module.materialise

    def spy(df, name):
        if name == label:
            found.append(df.rdd.getNumPartitions())
        return write(df, name)

    monkeypatch.setattr(module, "materialise", spy)
    return found


def test_training_rows_of_a_horizon_are_one_task(spark, monkeypatch):
    """However the features were split."""
    found = tasks_of(monkeypatch, training, "training")
    frame = spark.range(0, 100, numPartitions=9).select(
        (F.col("id") % 5 > 0).alias("is_train"), (F.col("id") % 3).cast("double").alias("x"), F.col("id").alias("y"))
    trained = training.train_one(frame, "24h", ["x"], "y", {"RIDGE": training.ridge})
    assert found == [1] and (trained.training_samples, trained.test_samples) == (80, 20)


def test_folds_of_a_search_are_one_task(data, monkeypatch):
    found = tasks_of(monkeypatch, tuning, "folds")
    model = tuning.boosting_search({"maxIter": [1], "maxDepth": [1]}, folds=2).fit(data[0].repartition(9))
    assert found == [1] and len(model.scores) == 1


def test_pruning_takes_splits_that_gain_too_little():
    tree = Trees(np.array([0]), np.array([0, -1, 1, -1, -1]), np.zeros(5), np.array([1, 0, 3, 0, 0]), np.array([2, 0, 4, 0, 0]),
                 np.array([0.0, -2.0, 2.0, 2.0, 2.01]), np.array([40, 20, 20, 10, 10]), np.array([0, 1, 1, 2, 2]))
    out = penalised(tree, 1.0, 0.0)
    assert out.feature.tolist() == [0, -1, -1, -1, -1]  # the lower split only splits the penalty
    assert out.value[1] == pytest.approx(-40 / 21)
    assert penalised(tree, 1.0, 1e9).feature.tolist() == [-1] * 5
    assert joined([tree, tree]).roots.tolist() == [0, 5]


def test_tree_sums_are_saved_and_loaded(spark, data, tmp_path):
    rows = data[0]
    model = tuning.PenalisedBoosting(rounds=3, depth=2).fit(rows)
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a, b = (sorted(r.prediction for r in m.transform(rows).collect()) for m in (model, loaded))
    assert a == b


@pytest.mark.parametrize("n", [1, 4, 5, 37, 5000])
def test_shuffled_split_is_exact(spark, n):
    df = spark.range(n).select((F.col("id") * 7).alias("seq")).repartition(3)
    marked = {r.seq for r in training.shuffled_split(df).where("is_train").collect()}
    order = sorted((hashlib.md5(f"42:{7 * i}".encode()).hexdigest(), 7 * i) for i in range(n))
    assert marked == {i for _, i in order[:n * 4 // 5]}


def test_trainers_leave_out_short_entities_and_record_quality(spark, tmp_path):
    import datetime

    from catalog import fixtures as fx

    rows = fx.readings(spark, "/root/testdata/sf0.01").where("location IN ('st0', 'st1')")
    short = rows.where("location = 'st1'").orderBy("timestamp").limit(29).withColumn("location", F.lit("short"))
    model = training.train_adaptive(rows.unionByName(short), ["24h"], {"Ridge": training.ridge})["24h"]
    assert {r.location for r in model.quality.collect()} == {"st0", "st1"}
    at = datetime.datetime(2024, 2, 1)
    version = training.save_and_register(spark, model, str(tmp_path), f"{tmp_path}/registry", at)
    record = spark.read.parquet(f"{tmp_path}/records/aqi_forecast_24h/{version}").collect()
    assert {r.location for r in record} == {"st0", "st1"}
    assert all(r.model_name == "Ridge" and r.training_samples == model.training_samples and r.uses_lags for r in record)
    assert training.train_adaptive(short, ["24h"], {"Ridge": training.ridge}) == {}
