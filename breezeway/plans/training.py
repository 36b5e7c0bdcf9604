"""Training, selection and saving of one model per forecast horizon (Spark ML).

All horizons share one feature frame with all targets, written once; every fit
and evaluation is a distributed job over it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.bands import clip_index
from breezeway.functions.calendar import version_stamp
from breezeway.operators.metrics import best_by_mae, best_by_r2, error_metrics
from breezeway.operators.quality import SAMPLE_GATES, data_quality, with_enough_rows
from breezeway.operators.series import Series, same_key
from breezeway.operators.shape import drop_missing, feature_names, fill_missing
from breezeway.operators.windows import with_split
from breezeway.plans.features import (
    adaptive_features, adaptive_leads, advanced_feature_names, advanced_features, full_features, hours_of,
    pick_adaptive_targets, simple_features,
)
from breezeway.plans.registry import register, registry_row, training_metadata
from breezeway.plans.tuning import (
    BOOSTING_GRID, FOREST_GRID, SEED, PenalisedBoosting, boosting_search, forest_search, laid_out,
)
from breezeway.session import materialise

log = logging.getLogger(__name__)
#: Hexadecimal digits by which a bucket of the split's histogram is refined.
SPLIT_DIGITS = 3


def split_hash(seq: str, seed: int) -> Column:
    """md5 of the seed and the id: an order that has nothing to do with the rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(seq).cast("string")).cast("binary"))


def cut_hash(df: DataFrame, n: int, seq: str = "seq", seed: int = SEED) -> str:
    """The ``n``-th least hash, by histograms: the bucket that holds it is refined until it is one hash.

    Each pass reads the ids alone and brings home at most 4,096 counts.
    """
    digest, prefix = df.select(split_hash(seq, seed).alias("h")), ""
    while len(prefix) < 32:
        width = min(len(prefix) + SPLIT_DIGITS, 32)
        inside = digest.where(F.col("h").startswith(prefix)) if prefix else digest
        counts = inside.groupBy(F.substring("h", 1, width).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("least"), F.max("h").alias("most")).orderBy("p").collect()
        for row in counts:
            if n <= row.n:
                break
            n -= row.n
        if row.least == row.most:
            return row.least
        prefix = row.p
    return prefix


def shuffled_split(df: DataFrame, seq: str = "seq", share: float = 0.8, seed: int = SEED,
                   name: str = "is_train") -> DataFrame:
    """Exactly floor(share * rows) rows are marked, those of the least hashes of ``seq``, which is unique.

    The same rows in every run and layout. Rows without an id are never marked.
    """
    rows = df.where(F.col(seq).isNotNull()).count()
    n = int(share * rows + 1e-9)
    if not n:
        return df.withColumn(name, F.lit(False))
    cut = cut_hash(df.where(F.col(seq).isNotNull()), n, seq, seed)
    return df.withColumn(name, F.coalesce(split_hash(seq, seed) <= cut, F.lit(False)))


def assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features as one vector plus the label; both must be free of NULLs."""
    vectors = VectorAssembler(inputCols=features, outputCol="features")
    kept = [c for c in df.columns if c not in features and c != target]
    labelled = df.withColumn("label", F.col(target).cast("double"))
    return vectors.transform(labelled).select(*kept, "features", "label")


def random_forest(trees: int = 100, depth: int | None = 10) -> RandomForestRegressor:
    """Every split sees all features; an unbounded depth becomes Spark's limit of 30."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=30 if depth is None else depth, featureSubsetStrategy="all", seed=SEED)


def gradient_boosting(rounds: int = 100, depth: int = 3, rate: float = 0.1) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED)


def deep_boosting(rounds: int = 100) -> PenalisedBoosting:
    """Boosted trees at depth 6 and rate 0.3 with penalised leaves, in place of the extra boosting library."""
    return PenalisedBoosting(rounds, depth=6, rate=0.3)


def ridge(train: DataFrame, alpha: float = 1.0) -> Pipeline:
    """Ridge with penalty ``alpha * |w|**2`` on the sum of squares, in closed form.

    Spark's penalty applies to the mean and to the scaled label, hence the factor.
    Constant features, which carry no weight, are left out: Spark does not
    penalise them, so they would make the closed form singular.
    """
    stats = train.agg(F.stddev_pop("label").alias("sd"), F.count("label").alias("n")).first()
    penalty = alpha * (stats["sd"] or 1.0) / max(stats["n"], 1)
    return Pipeline(stages=[
        VarianceThresholdSelector(featuresCol="features", outputCol="varying", varianceThreshold=0.0),
        LinearRegression(featuresCol="varying", elasticNetParam=0.0, standardization=False,
                         solver="normal", regParam=penalty),
    ])


Candidates = dict[str, Callable[[DataFrame], Estimator]]
QUALITY_FIGURES = ["total_records", "max_consecutive", "can_use_lags", "can_forecast"]
#: Candidates that are fitted at once, and horizons.
AT_ONCE = 4

ADAPTIVE_CANDIDATES: Candidates = {
    "RandomForest": lambda _: random_forest(100, 10),
    "GradientBoosting": lambda _: gradient_boosting(100, 5),
    "Ridge": ridge,
}
SIMPLE_CANDIDATES: Candidates = {
    "RANDOM_FOREST": lambda _: random_forest(50, 10),
    "GRADIENT_BOOST": lambda _: gradient_boosting(50, 5),
    "RIDGE": ridge,
}
FULL_CANDIDATES: Candidates = {
    "RANDOM_FOREST": lambda _: random_forest(100, None),
    "GRADIENT_BOOSTING": lambda _: gradient_boosting(100),
    "XGBOOST": lambda _: deep_boosting(100),
    "RIDGE": ridge,
}

def tuned_candidates(boosting: dict[str, list] = BOOSTING_GRID, forest: dict[str, list] = FOREST_GRID,
                     folds: int = 3, parallelism: int = 4) -> Candidates:
    return {
        "GradientBoosting": lambda _: boosting_search(boosting, folds, parallelism),
        "RandomForest": lambda _: forest_search(forest, folds, parallelism),
    }


@dataclass(frozen=True)
class Trained:
    """The chosen model of one horizon."""

    horizon: str
    name: str
    model: PipelineModel
    features: list[str]
    metrics: dict[str, float]
    training_samples: int
    test_samples: int
    all_metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    #: what the trainer knew: model_type, data_quality, uses_lags, optimization
    details: dict[str, str] = field(default_factory=dict)
    #: quality figures of the entities it learned from, one row each
    quality: DataFrame | None = None


def fit_all(candidates: Candidates, train: DataFrame) -> dict[str, object]:
    """All candidates fitted; fits are chains of short jobs, so several at once keep the cluster busy."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(candidates, pool.map(lambda build: build(train).fit(train), candidates.values())))


def predict(model, rows: DataFrame) -> DataFrame:
    """Predictions clipped to the five-step scale."""
    return model.transform(rows).withColumn("prediction", clip_index(F.col("prediction")))


def evaluate(models: dict[str, object], test: DataFrame) -> DataFrame:
    """Error metrics of every candidate on the test rows: (model, rank, n, mae, rmse, r2)."""
    parts = [
        error_metrics(predict(model, test), "label", "prediction")
        .select(F.lit(name).alias("model"), F.lit(rank).alias("rank"), "*")
        for rank, (name, model) in enumerate(models.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def train_one(frame: DataFrame, horizon: str, features: list[str], target: str,
              candidates: Candidates, choose: str = "mae", least: int = 1) -> Trained:
    """Fit all candidates on the rows marked ``is_train`` and keep the best on the others."""
    ready = materialise(laid_out(assemble(frame.select("is_train", target, *features), features, target)), "training")
    if not _has_rows(ready, least):
        raise TooFewRows(f"fewer than {least} rows")
    train, test = ready.filter("is_train"), ready.filter(~F.col("is_train"))
    fitted = fit_all(candidates, train)
    scores = materialise(evaluate(fitted, test), "scores")
    pick = best_by_mae if choose == "mae" else best_by_r2
    best = pick(scores, []).first()["model"]
    # one row per candidate
    rows = {r["model"]: {m: r[m] for m in ("mae", "rmse", "r2")} for r in scores.toLocalIterator()}
    counts = ready.agg(F.count_if("is_train").alias("train"), F.count(F.lit(1)).alias("n")).first()
    chosen = getattr(fitted[best], "bestModel", fitted[best])
    whole = PipelineModel([VectorAssembler(inputCols=features, outputCol="features"), chosen])
    return Trained(horizon, best, whole, features, rows[best], counts["train"],
                   counts["n"] - counts["train"], rows)


def adaptive_frames(readings: DataFrame, horizons: list[str] = V.HORIZONS,
                    s: Series = Series()) -> tuple[DataFrame, list[str]]:
    """Features and targets of the adaptive trainer, for all horizons at once.

    Lags are used when every entity's longest run allows them.
    """
    quality = materialise(data_quality(readings, s), "quality")
    use_lags = bool(quality.agg(F.bool_and("can_use_lags").alias("ok")).first()["ok"])
    frame = adaptive_features(readings, use_lags, s, adaptive_leads(horizons))
    frame = pick_adaptive_targets(frame, quality, horizons, s)
    extra = [f"target_aqi_{h}" for h in horizons]
    quality_columns = ["total_records", "max_consecutive", "can_use_lags", "can_forecast", "model_type"]
    features = feature_names(frame, [*V.NOT_FEATURES_ADAPTIVE, *extra, *quality_columns], numeric_only=True)
    return frame, features


def train_adaptive(readings: DataFrame, horizons: list[str] = V.HORIZONS,
                   candidates: Candidates = ADAPTIVE_CANDIDATES, s: Series = Series()) -> dict[str, Trained]:
    readings = with_enough_rows(readings, SAMPLE_GATES["adaptive"][0], s)
    if not _has_rows(readings, 1):
        return {}
    frame, features = adaptive_frames(readings, horizons, s)
    frame = materialise(frame, "features")

    def rows(h: str) -> tuple[DataFrame, list[str], str]:
        target = f"target_aqi_{h}"
        clean = with_enough_rows(drop_missing(frame, [*features, target]), SAMPLE_GATES["adaptive"][1], s)
        return with_split(clean, s), features, target

    found = _each_horizon(horizons, rows, candidates, "mae", 1)
    quality = materialise(frame.select(*s.key, *QUALITY_FIGURES).distinct(), "quality")
    # one row per model type, at most three
    kinds = frame.groupBy("model_type").agg(
        F.max("max_consecutive").alias("longest")).collect()
    details = {
        "model_type": ",".join(sorted(str(k["model_type"]) for k in kinds)),
        "uses_lags": str(any("_lag_" in f for f in features)).lower(),
        "data_quality": f"longest run {max((k['longest'] or 0 for k in kinds), default=0)}",
    }
    return {h: replace(t, details=details, quality=quality) for h, t in found.items()}


def train_adaptive_by_type(readings: DataFrame, horizons: list[str] = V.HORIZONS,
                           candidates: Candidates = ADAPTIVE_CANDIDATES,
                           s: Series = Series()) -> dict[str, dict[str, Trained]]:
    """Models per model type: entities with long enough runs forecast, the others nowcast.

    Each type has its own frame, so a label is either the future index or the current one,
    and entities with short runs take no lags from those with long ones.
    """
    quality = materialise(data_quality(readings, s), "quality")
    out = {}
    for name, can in (("Forecasting", True), ("Nowcasting", False)):
        own = quality.filter(F.col("can_forecast") == can).select(*s.key)
        found = train_adaptive(readings.join(own, same_key(readings, own, list(s.key)), "left_semi"), horizons, candidates, s)
        if found:
            out[name] = found
    return out


def train_simple(readings: DataFrame, horizons: list[str] = V.HORIZONS,
                 candidates: Candidates = SIMPLE_CANDIDATES, s: Series = Series()) -> dict[str, Trained]:
    readings = with_enough_rows(readings, SAMPLE_GATES["simple"][0], s)
    if not _has_rows(readings, 1):
        return {}

    def rows(h: str) -> tuple[DataFrame, list[str], str]:
        target = f"target_aqi_{hours_of(h)}h"
        skip = ["timestamp", "location", "_id", target, "aqi"]
        frame = simple_features(readings, hours_of(h), s, subset=[])
        features = feature_names(frame, skip, numeric_only=True)
        clean = with_enough_rows(drop_missing(frame, [*features, target]), SAMPLE_GATES["simple"][1], s)
        return with_split(clean, s), features, target

    return _each_horizon(horizons, rows, candidates, "mae", 1)


def train_full(readings: DataFrame, horizons: list[str] = V.HORIZONS,
               candidates: Candidates = FULL_CANDIDATES, s: Series = Series()) -> dict[str, Trained]:
    frame = materialise(full_features(readings, horizons, s), "features")
    features = feature_names(frame, V.NOT_FEATURES_FULL, numeric_only=True)

    def rows(h: str) -> tuple[DataFrame, list[str], str]:
        target = f"aqi_{h}_ahead"
        return with_split(drop_missing(frame, [*features, target]), s), features, target

    return _each_horizon(horizons, rows, candidates, "mae", 1)


def train_tuned(readings: DataFrame, horizons: list[str] = V.HORIZONS, candidates: Candidates | None = None,
                s: Series = Series(), source: str | None = None) -> dict[str, Trained]:
    """The tuned trainer: advanced features, missing values as 0, shuffled split, best R2.

    ``source`` takes the readings of one source only.
    """
    if source is not None:
        readings = readings.filter(F.col("source") == source)
    targets = {f"target_aqi_{h}": hours_of(h) for h in horizons}
    frame = materialise(advanced_features(readings, s, targets), "features")
    features = advanced_feature_names()

    def rows(h: str) -> tuple[DataFrame, list[str], str]:
        target = f"target_aqi_{h}"
        clean = fill_missing(drop_missing(frame, [target]), features)
        return shuffled_split(clean, s.seq), features, target

    found = _each_horizon(horizons, rows, candidates or tuned_candidates(), "r2", 1)
    details = {"optimization": "grid search" if candidates is None else "given candidates", "uses_lags": "true"}
    return {h: replace(t, details=details) for h, t in found.items()}


def _has_rows(df: DataFrame, least: int) -> bool:
    enough = len(df.select(F.lit(1)).take(least)) >= least
    if not enough:
        log.warning("fewer than %d rows", least)
    return enough


class TooFewRows(Exception):
    """A horizon has fewer rows than its trainer asks for."""


def _each_horizon(horizons: list[str], rows: Callable, candidates: Candidates, choose: str,
                  least: int) -> dict[str, Trained]:
    """Train horizon by horizon; one with too few rows is skipped and logged, other errors are raised."""
    def one(h: str) -> Trained | None:
        frame, features, target = rows(h)
        try:
            return train_one(frame, h, features, target, candidates, choose, least)
        except TooFewRows as e:
            log.warning("horizon %s skipped: %s", h, e)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = dict(zip(horizons, pool.map(one, horizons)))
    return {h: t for h, t in found.items() if t}


def horizon_status(horizons: list[str], trained: dict[str, Trained]) -> dict[str, str]:
    """``trained`` or ``too few rows`` for each asked horizon."""
    return {h: "trained" if h in trained else "too few rows" for h in horizons}


def save_and_register(spark, trained: Trained, model_root: str, registry_path: str, at,
                      stage: str = "staging", s: Series = Series()) -> str:
    """Save the model and its training record, append its registry row, and return its version."""
    stamp = spark.range(1).select(version_stamp(F.lit(at)).alias("v")).first()["v"]
    name = f"aqi_forecast_{trained.horizon}"
    path = f"{model_root}/{name}/{stamp}"
    trained.model.write().overwrite().save(path)
    if trained.quality is not None:
        training_record(trained, at, s).write.mode("overwrite").parquet(f"{model_root}/records/{name}/{stamp}")
    metadata = {
        "algorithm": trained.name, "features": str(len(trained.features)),
        "training_samples": str(trained.training_samples), "test_samples": str(trained.test_samples),
        "horizon": trained.horizon, **trained.details,
    }
    register(registry_path, registry_row(
        spark, name, stamp, path, trained.metrics, trained.features, at, metadata, stage))
    return stamp


def training_record(trained: Trained, at, s: Series = Series()) -> DataFrame:
    """What the trainer knew of a model: one row for each entity it learned from."""
    models = trained.quality.select(
        *s.key, F.lit(trained.name).alias("model_name"), F.array(*[F.lit(c) for c in trained.features]).alias("feature_cols"),
        F.create_map(*[F.lit(v) for item in trained.metrics.items() for v in item]).alias("metrics"),
        F.lit(at).cast("timestamp").alias("trained_on"), F.lit(trained.training_samples).cast("long").alias("training_samples"),
        F.lit(trained.test_samples).cast("long").alias("test_samples"), F.lit(trained.horizon).alias("horizon"),
        F.lit(trained.details.get("model_type")).alias("model_type"))
    return training_metadata(models, trained.quality, list(s.key))


def load_model(registry_row) -> PipelineModel:
    """The model a registry row points at."""
    return PipelineModel.load(registry_row["file_path"])


def scorer_of(model: PipelineModel):
    """A scorer for ``serving.forecast``."""
    return lambda rows: model.transform(rows).drop("features", "varying")
