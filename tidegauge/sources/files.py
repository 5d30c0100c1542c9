"""File sources: wide CSV, series lists, sensor folders; and the table sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.functions.names import dataset_of, file_stem
from tidegauge.operators.order import rank_within
from tidegauge.session import stored

_READERS: dict[str, Callable] = {}


def register_reader(name: str, fn: Callable) -> None:
    if name in _READERS:
        raise ValueError(f"reader {name} is already registered")
    _READERS[name] = fn


def reader(name: str) -> Callable:
    return _READERS[name]


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _line_place() -> list:
    """Order of a line: its file, the start of the file split, then order inside the task."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
    ]


_PLACE = ["_file", "_blk", "_mid"]


def _dataset_of(path: str):
    """A path names one dataset, be it a file or a folder of part files; a pattern names many."""
    if any(c in path for c in "*?[{"):
        return dataset_of([path], F.col("_metadata.file_path"))
    return file_stem(F.lit(path.rstrip("/")))


def _distinct_names(paths: list[str]) -> None:
    """Two paths that would name one dataset would merge their series."""
    seen: dict[str, str] = {}
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
        if not any(c in path for c in "*?[{") and seen.setdefault(name, path) != path:
            raise ValueError(f"{seen[name]} and {path} would both be dataset {name}; read them apart or by a pattern")


def _csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).csv(paths)


def read_wide_csv(
    spark: SparkSession, paths: str | list[str], time_col: str | None = None, parse_time: bool = True,
    only: list[str] | None = None,
) -> DataFrame:
    """Every column but the first is one series; a file is one dataset.

    Files are read one by one, as their columns differ.  ``only`` names the
    series wanted, so that the scan leaves the other columns out.  Rows keep
    their file order.
    """
    parts = []
    _distinct_names(_paths(paths))
    for path in _paths(paths):
        raw = _csv(spark, [path])
        time = time_col or raw.columns[0]
        values = [c for c in raw.columns if c != time and (only is None or c in only)]
        rows = raw.select(
            _dataset_of(path).alias("dataset"),
            F.col(f"`{time}`").alias("ts"),
            *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in values],
            *_line_place(),
        )
        parts.append(rows.unpivot(["dataset", "ts", *_PLACE], values, "series_id", "y"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = rank_within(out, KEYS, _PLACE, "idx")
    ts = F.expr("try_cast(ts as timestamp_ntz)") if parse_time else F.col("ts")
    return out.select("dataset", "series_id", "idx", ts.alias("ts"), "y")


def read_series_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Several all-numeric files; rows with any missing value are dropped.

    CSV, Parquet and ORC are told apart by suffix.  The rows are stored once
    with their number inside their task; the rows before a file split come
    from a table of one row per split, so no row is sorted or sent on.
    """
    parts, runs = [], []
    for k, path in enumerate(_paths(paths)):
        kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind == "feather":
            raise ValueError("Spark reads no Feather files; convert them to Parquet first")
        raw = _csv(spark, [path]) if kind == "csv" else spark.read.format(kind).load(path)
        values = raw.columns
        rows = raw.select(
            _dataset_of(path).alias("dataset"),
            *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in values],
            *_line_place()[:2],
        ).dropna("any", subset=values)
        for v in values:
            rows = rows.filter(~F.isnan(F.col(f"`{v}`")))
        names = [f"_v{i}" for i in range(len(values))]  # a file format may not take every name
        split = ["dataset", "_file", "_blk"]
        kept = rows.select(*split, F.monotonically_increasing_id().alias("_mid"), *[F.col(f"`{v}`").alias(n) for v, n in zip(values, names, strict=True)])
        kept = stored(kept, "list-rows").select(F.lit(k).alias("_part"), *split, "_mid", *[F.col(n).alias(v) for v, n in zip(values, names, strict=True)])
        parts.append(kept.unpivot(["dataset", "_part", "_file", "_blk", "_mid"], values, "series_id", "y"))
        found = kept.groupBy("_part", *split).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        runs.append(found.withColumn("series_id", F.explode(F.array(*[F.lit(v) for v in values]))))
    earlier = Window.partitionBy(*KEYS).orderBy("_file", "_blk", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = union_all(runs).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # One row per series and file split: few beside the rows they stand for.
    before = F.broadcast(before.select("series_id", "_part", "_file", "_blk", "_first", "_before"))
    out = union_all(parts).join(before, ["series_id", "_part", "_file", "_blk"])
    idx = (F.col("_before") + F.col("_mid") - F.col("_first")).alias("idx")
    return out.select(*KEYS, idx, F.lit(None).cast("timestamp_ntz").alias("ts"), "y")


def read_sensor_folders(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """Header-less ``time, axis1, axis2, ...`` files of any width; a folder is one recording.

    Without ``patterns`` every CSV or TXT file is taken and files holding anything but numbers are left out.  ``place`` keeps
    the order of samples of one time: block of the file and line in it.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("sep", "\u0001").option("quote", "").schema("line string").csv(root)
    raw = raw.select("line", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
                     F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    if patterns:
        raw = raw.filter(F.col("file").isin(list(patterns)))
    else:
        raw = raw.filter(F.lower("file").rlike(r"\.(csv|txt)$"))
    cell = F.transform(F.split("line", ","), lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"))
    cells = raw.filter(F.trim("line") != "").select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "path", F.regexp_extract("file", r"^([^.]*)", 1).alias("sensor"),
        "place", cell.alias("_c"))
    long = cells.select(
        "folder", "path", "sensor", "place", F.expr("try_cast(_c[0] as double)").alias("t"),
        F.posexplode(F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0)))).alias("_a", "_v"),
    ).filter(F.col("_v") != "")
    long = long.select("folder", "path", "sensor", "t", (F.col("_a") + 1).alias("axis"), F.expr("try_cast(_v as double)").alias("v"), "place")
    if not patterns:
        bad = long.filter(F.col("v").isNull() | F.col("t").isNull()).select("path").distinct()
        long = long.join(bad, "path", "left_anti")
    return long.drop("path")


def rejected_cells(spark: SparkSession, paths: str | list[str], time_col: str | None = None, has_time: bool = True) -> DataFrame:
    """(dataset, series_id, cell, n): what stands in value columns of wide CSV or list files and is no number.

    The readers make such a cell NULL, or leave its row out; empty cells are missing values and are not listed.
    """
    out = None
    _distinct_names(_paths(paths))
    for path in _paths(paths):
        raw = _csv(spark, [path])
        time = (time_col or raw.columns[0]) if has_time else None
        values = [c for c in raw.columns if c != time]
        rows = raw.select(_dataset_of(path).alias("dataset"), *[F.col(f"`{c}`") for c in values]).unpivot(["dataset"], values, "series_id", "cell")
        bad = rows.filter("cell is not null and try_cast(cell as double) is null")
        out = bad if out is None else out.unionByName(bad)
    return out.groupBy("dataset", "series_id", "cell").agg(F.count(F.lit(1)).alias("n"))


def drop_missing(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Remove missing points and close the gaps in ``idx``."""
    kept = series.filter(F.col("y").isNotNull() & ~F.isnan("y")).withColumnRenamed("idx", "_old")
    return rank_within(kept, keys, ["_old"], "idx").select(*series.columns)


def min_length(series: DataFrame, n: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """Leave out series with fewer than ``n`` points."""
    enough = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return series.join(enough.select(*keys), keys, "left_semi")


def drop_column(df: DataFrame, name: str = "date") -> DataFrame:
    return df.drop(name)


def select_series(series: DataFrame, mode: str = "S", target: str = "OT") -> DataFrame:
    """``S`` keeps the target series, ``M`` and ``MS`` keep all."""
    if mode not in ("S", "M", "MS"):
        raise ValueError("mode must be S, M or MS")
    return series.filter(F.col("series_id") == target) if mode == "S" else series


def target_last(df: DataFrame, target: str, time_col: str = "date") -> DataFrame:
    """Column order: time, other columns, target."""
    others = [c for c in df.columns if c not in (target, time_col)]
    return df.select(time_col, *others, target)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union of series or prompt tables by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    prompts.write.mode(mode).partitionBy("split", "dataset").parquet(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    params.write.mode(mode).parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(features: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder of feature rows per recording."""
    writer = features.write.mode(mode).partitionBy("folder")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)
