"""Model registry kept as a table of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.operators.series import Series, with_positions
from breezeway.schemas import REGISTRY, TRAINING_METADATA
from breezeway.sources.readings import latest
from breezeway.sources.commits import read_version, versions, write_version


def active(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "active")


def _chosen(registry: DataFrame, name: str | None, version: str | None, stage: str | None) -> DataFrame:
    for column, value in {"model_name": name, "version": version, "stage": stage}.items():
        if value is not None:
            registry = registry.filter(F.col(column) == value)
    return registry


def list_models(registry: DataFrame, name: str | None = None, stage: str | None = None) -> DataFrame:
    """Active models, newest first."""
    return _chosen(active(registry), name, None, stage).orderBy(F.desc("registered_at"))


def newest_models(registry: DataFrame, version: str | None = None, stage: str | None = None,
                  name: str | None = None) -> DataFrame:
    """The newest active version of each name that passes the filters."""
    rows = _chosen(active(registry), name, version, stage)
    return latest(rows, Series(("model_name",), "registered_at", "version"))


def production_models(registry: DataFrame, name: str | None = None) -> DataFrame:
    return newest_models(registry, stage="production", name=name)


def promote(registry: DataFrame, wanted: DataFrame, at: Column | None = None, order: str = "version") -> DataFrame:
    """The registry after promoting each wanted (model_name, version).

    The name's active production versions are archived and the wanted one takes
    their place. A name whose wanted version is not active stays untouched. Of several
    wanted versions of a name the last by the column ``order`` of ``wanted`` wins.
    """
    at = F.current_timestamp() if at is None else at
    there = wanted.join(active(registry).select("model_name", "version").distinct(), ["model_name", "version"], "left_semi")
    found = there.groupBy("model_name").agg(F.max_by("version", F.col(order)).alias("_wanted"))
    is_active = F.col("status") == "active"
    chosen = is_active & (F.col("version") == F.col("_wanted"))
    retired = is_active & F.col("_wanted").isNotNull() & (F.col("stage") == "production")
    rows = registry.join(found, "model_name", "left").withColumns({
        "_chosen": F.coalesce(chosen, F.lit(False)), "_retired": F.coalesce(retired, F.lit(False))})
    return rows.withColumns({
        "stage": F.when(F.col("_chosen"), "production").when(F.col("_retired"), "archived")
                  .otherwise(F.col("stage")),
        "archived_at": F.when(F.col("_retired"), at).otherwise(F.col("archived_at")),
        "promoted_at": F.when(F.col("_chosen"), at).otherwise(F.col("promoted_at")),
    }).select(*registry.columns)


def promotion_result(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted (model_name, version) and whether an active row has it."""
    there = active(registry).select("model_name", "version").distinct().withColumn("_found", F.lit(True))
    return wanted.join(there, ["model_name", "version"], "left").select(
        "model_name", "version", F.coalesce("_found", F.lit(False)).alias("found"))


def wanted_versions(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry rows of the wanted versions, one row per wanted version at least."""
    return wanted.join(registry, ["model_name", "version"], "left")


def compare_models(registry: DataFrame, metric: str = "r2", name: str | None = None,
                   top: int | None = None) -> DataFrame:
    """Active versions of each name ranked by a metric: r2 high to low, others low to high.

    Versions without the metric come last; ``top`` keeps the best few per name.
    """
    value = F.try_element_at("metrics", F.lit(metric))
    sort = F.coalesce(-value if metric == "r2" else value, F.lit(float("inf")))
    tie = F.struct((-F.unix_micros("registered_at")).alias("age"), "version")
    rows = _chosen(active(registry), name, None, None).withColumns(
        {"metric_value": value, "_sort": sort, "_tie": tie})
    if top is None:
        ranked = with_positions(rows, Series(("model_name",), "_sort", "_tie"), "place", "_total")
        return ranked.drop("_sort", "_tie", "_total")
    w = Window.partitionBy("model_name").orderBy("_sort", "_tie")
    best = rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top)
    return best.drop("_sort", "_tie")


def model_history(registry: DataFrame, name: str) -> DataFrame:
    """Every version of a name, inactive ones too, newest first."""
    return _chosen(registry, name, None, None).orderBy(F.desc("registered_at"))


def registry_row(spark, model_name: str, version: str, file_path: str, metrics: dict[str, float],
                 feature_cols: list[str], registered_at, metadata: dict[str, str] | None = None,
                 stage: str = "staging") -> DataFrame:
    """One new registry row."""
    row = (model_name, version, stage, "active", "training_pipeline", file_path, feature_cols,
           metrics, metadata or {}, registered_at, None, None)
    return spark.createDataFrame([row], REGISTRY)


def _store(registry: DataFrame, path: str) -> None:
    spark = registry.sparkSession
    write_version(registry, path, "registry", max(versions(spark, path, "registry"), default=0) + 1)


def register(registry_path: str, row: DataFrame) -> None:
    """Add rows to the stored registry: a new committed version of it."""
    before = read_registry(row.sparkSession, registry_path)
    _store(before.unionByName(row.select(*before.columns)), registry_path)


def promote_stored(spark, registry_path: str, wanted: DataFrame, at: Column | None = None,
                   order: str = "version") -> None:
    """Promote in the stored registry; lookups from now on see the new stages."""
    _store(promote(read_registry(spark, registry_path), wanted, at, order), registry_path)


def read_registry(spark, registry_path: str) -> DataFrame:
    """The newest committed version of the registry."""
    return read_version(spark, registry_path, "registry", REGISTRY)


def training_metadata(models: DataFrame, quality: DataFrame, key: list[str] = ["location"]) -> DataFrame:
    """Training records: model rows joined with their entity's quality figures."""
    joined = models.join(quality, key)
    data_quality = F.struct("total_records", "max_consecutive", "can_use_lags", "can_forecast")
    return joined.withColumn("data_quality", data_quality).withColumn(
        "uses_lags", F.col("can_use_lags")).select(*key, *TRAINING_METADATA.names)
