"""Sensor folders to window features: read, merge on a time grid, cut, describe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.config import KEYS
from tidegauge.features.extract import extract_windows
from tidegauge.functions.names import clean_path
from tidegauge.operators.joins import merge_sensors
from tidegauge.sources.files import read_sensor_folders


def sensor_features(
    sensors: DataFrame, resample_rate: float = 30, time_unit: float = 1e9, window_size: int = 100,
    overlap: float = 0.0, pre_process: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> DataFrame:
    """Window features of every recording: ``folder, series_id, win_id, feature, k, value``."""
    prepared = sensors.transform(pre_process) if pre_process else sensors
    merged = merge_sensors(prepared, resample_rate, time_unit)
    options.setdefault("fs", resample_rate)
    out = extract_windows(merged, window_size, overlap, KEYS, **options)
    return out.withColumn("dataset", clean_path(out["dataset"])).withColumnRenamed("dataset", "folder")


def folder_features(
    spark: SparkSession, root: str, patterns: list[str] | None = None, **settings
) -> DataFrame:
    """The same from the files below ``root``."""
    return sensor_features(read_sensor_folders(spark, root, patterns), **settings)
