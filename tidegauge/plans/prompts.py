"""The prompt bank: features per series and split, normalised and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.features.extract import PRUNED, extract, prune, vectors
from tidegauge.features.registry import catalogue, select
from tidegauge.operators.sampling import at_most
from tidegauge.operators.splits import split_plain
from tidegauge.session import cut_lineage
from tidegauge.sources.files import min_length

SPLIT_KEYS = ["split", *KEYS]


def generate_prompts(
    series: DataFrame, train: float = 0.7, val: float = 0.1, rules: DataFrame | None = None,
    min_points: int = 20, **options,
) -> DataFrame:
    """Features of the three consecutive parts of every series, pruned, in long form."""
    parts = split_plain(min_length(series, min_points), train, val, rules)
    if not {"domain", "tag", "names"} & options.keys():
        options["names"] = [f.name for f in select() if not f.name.startswith(PRUNED)]
    return prune(extract(parts, SPLIT_KEYS, **options))


def fit_prompt_scaler(
    prompts: DataFrame, per_dataset: int | None = None, seed: int = 0
) -> DataFrame:
    """Mean and scale of each feature per split, over all series or a sample of ``per_dataset`` of each dataset."""
    if per_dataset is not None:
        series = prompts.select(*SPLIT_KEYS).distinct()
        prompts = prompts.join(at_most(series, ["split", "dataset"], ["series_id"], per_dataset, seed), SPLIT_KEYS, "left_semi")
    std = F.stddev_pop("value")
    value = F.when(~F.isnan("value"), F.col("value"))
    return (
        prompts.withColumn("value", value)
        .groupBy("split", "feature", "k")
        .agg(F.avg("value").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"))
    )


def scale_prompts(prompts: DataFrame, params: DataFrame) -> DataFrame:
    """(value - mean) / scale; what is missing or NaN becomes 0.

    ``params`` has one row per split and feature output, a few hundred in all.
    """
    on = ["split", "feature", "k"]
    z = (F.col("value") - F.col("mean")) / F.col("scale")
    return prompts.join(F.broadcast(params), on).select(
        *SPLIT_KEYS, "feature", "k", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias("value")
    )


def pack_prompts(prompts: DataFrame) -> DataFrame:
    """One name-sorted vector per split and series."""
    return vectors(prompts, SPLIT_KEYS, catalogue(prompts.sparkSession)).drop("names")


def build_bank(series: DataFrame, per_dataset: int | None = None, seed: int = 0, **options) -> DataFrame:
    """Normalised, packed prompts; features are computed once and kept for fit and transform."""
    prompts = cut_lineage(generate_prompts(series, **options))
    return pack_prompts(scale_prompts(prompts, fit_prompt_scaler(prompts, per_dataset, seed)))


def prompt_map(vecs: DataFrame, per_group: int | None = None, seed: int = 0) -> DataFrame:
    """Two principal components of all prompts, or of ``per_group`` of each dataset and split, labelled by both."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some = vecs if per_group is None else at_most(vecs, ["split", "dataset"], ["series_id"], per_group, seed)
    data = some.withColumn("_v", array_to_vector("features"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(data)
    xy = vector_to_array("_p")
    return model.transform(data).select(*SPLIT_KEYS, xy[0].alias("pc1"), xy[1].alias("pc2"))
