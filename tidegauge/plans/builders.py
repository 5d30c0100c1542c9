"""Sample builders: from series to model-ready windows in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import KEYS, PrepConfig
from tidegauge.functions.arrays import tokenise
from tidegauge.functions.calendar import fields_for, future_timestamps, plain_fields
from tidegauge.operators.joins import dataset_index
from tidegauge.operators.order import join_groups
from tidegauge.operators.packed import (
    Packed,
    fit_prefix,
    keyed_prompts,
    ordinal_prompts,
    pack,
    packed_windows,
    prompt_blocks,
    wanted_keys,
)
from tidegauge.operators.sampling import shuffled_batches
from tidegauge.operators.scaling import fit_on_train, processor
from tidegauge.operators.splits import (
    lengths,
    lookback_bounds,
    part,
    prediction_tail,
    split_borders,
    split_calendar,
    split_lookback,
    truncate_rows,
)
from tidegauge.operators.windows import require_length, sample_windows, with_prefix
from tidegauge.sources.files import read_wide_csv, select_series
from tidegauge.sources.tsf import read_tsf, tsf_series

SPLIT_KEYS = ["split", *KEYS]


def scaled_splits(
    series: DataFrame, cfg: PrepConfig, rules: DataFrame | None = None, fit_rows: str = "all",
    scaler: str = "standard_scaler",
) -> DataFrame:
    """Look-back splits, standardised per series.

    The scaler reads the whole series by default, rows beyond a dataset's cap
    included; ``fit_rows="truncated"`` leaves those out, and
    ``cfg.scale_on_train`` restricts it to the train split.
    """
    kept = truncate_rows(series, rules) if rules is not None else series
    parts = split_lookback(kept, cfg.seq_len, cfg.pred_len, cfg.train_ratio, cfg.val_ratio, rules)
    fit, transform, _ = processor(scaler)
    if cfg.scale_on_train:
        params = fit_on_train(parts) if scaler == "standard_scaler" else fit(parts.filter("split = 'train'"))
    else:
        params = fit(kept if fit_rows == "truncated" else series)
    return transform(parts, params)


def cut_samples(
    parts: DataFrame, cfg: PrepConfig, split_names: list[str], stride: dict[str, int],
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    wanted = parts.filter(F.col("split").isin(split_names))
    if cfg.strict:
        require_length(wanted, cfg.seq_len + cfg.pred_len, SPLIT_KEYS)
    out = None
    for step in sorted({stride[s] for s in split_names}):
        names = [s for s in split_names if stride[s] == step]
        some = wanted.filter(F.col("split").isin(names))
        w = sample_windows(some, cfg.seq_len, cfg.pred_len, step, SPLIT_KEYS, attach=attach)
        out = w if out is None else out.unionByName(w)
    return out


Source = DataFrame | Packed


def packed_for(source: Source, cfg: PrepConfig, rules: DataFrame | None = None) -> Packed:
    """A long series table is stored in chunks first; a packed one is used as it is.

    Its length is cut to the cap of the dataset's rule, and its split ratios stand beside it.
    """
    packed = source if isinstance(source, Packed) else pack(source, cfg.seq_len + cfg.pred_len)
    chunks, train, val = packed.chunks, F.lit(cfg.train_ratio), F.lit(cfg.val_ratio)
    if rules is not None:
        own = F.broadcast(rules.select("dataset", "train_ratio", "val_ratio", "row_cap"))  # one row per known dataset
        chunks = chunks.join(own, "dataset", "left").withColumn("n", F.least("n", F.coalesce("row_cap", "n"))).drop("row_cap")
        train, val = F.coalesce("train_ratio", train), F.coalesce("val_ratio", val)
    return replace(packed, chunks=chunks.withColumns({"train_ratio": train, "val_ratio": val}))


def _lookback(cfg: PrepConfig):
    """Bounds of the look-back splits, and what a series must fulfil, over columns of the packed table."""
    ratios = F.col("train_ratio"), F.col("val_ratio")
    return lookback_bounds(cfg.seq_len, *ratios), part(F.col("n"), ratios[0]) >= cfg.seq_len + cfg.pred_len


def lookback_windows(
    source: Source, cfg: PrepConfig, splits: list[str], stride: dict[str, int], rules: DataFrame | None = None,
    prompts: DataFrame | None = None, find: Callable[[DataFrame, DataFrame], DataFrame] = keyed_prompts, fit_rows: str = "all",
) -> DataFrame:
    """Standardised windows of the look-back splits, with the vector of their series if ``prompts`` are given.

    One scan of the packed table; only chunks and prompts meet in an exchange.  The scaler reads the whole series, rows beyond
    a dataset's cap included; ``fit_rows="truncated"`` leaves those out, and ``cfg.scale_on_train`` reads the train part only.
    A series without prompt raises, or is left out with ``cfg.on_missing="drop"``.
    """
    packed = packed_for(source, cfg, rules)
    bounds, guard = _lookback(cfg)
    bounds = {name: bounds[name] for name in splits}
    span = cfg.seq_len + cfg.pred_len
    if cfg.strict:
        short = _split_keys(packed, bounds, guard).filter((F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") < span)).limit(1).collect()
        if short:
            raise ValueError(f"series shorter than {span} points: {short[0].asDict()}")
    params = None
    if cfg.scale_on_train:
        params = fit_prefix(packed, part(F.col("n"), F.col("train_ratio")))
    elif fit_rows == "truncated":
        params = fit_prefix(packed, F.col("n"))
    attach = None
    if prompts is not None:
        attach = prompt_blocks(packed, find(_split_keys(packed, bounds, guard, span), prompts), cfg.on_missing)
    return packed_windows(packed, bounds, cfg.seq_len, cfg.pred_len, stride, guard, attach, params)


def _split_keys(packed: Packed, bounds, guard, span: int | None = None) -> DataFrame:
    """(split, keys, lo, hi) per series and split; with ``span``, of those that hold a window."""
    return wanted_keys(packed, bounds, -(1 << 62) if span is None else span, guard)


def missing_prompts(
    source: Source, prompts: DataFrame, cfg: PrepConfig = PrepConfig(), splits: list[str] | None = None,
    rules: DataFrame | None = None, find: Callable[[DataFrame, DataFrame], DataFrame] = keyed_prompts,
) -> DataFrame:
    """split, dataset and series_id of all that has windows but no prompt: what ``on_missing="drop"`` leaves out."""
    packed = packed_for(source, cfg, rules)
    bounds, guard = _lookback(cfg)
    bounds = {name: bounds[name] for name in splits or TRAIN}
    found = find(_split_keys(packed, bounds, guard, cfg.seq_len + cfg.pred_len), prompts)
    return found.filter(F.col("prompt").isNull()).select(*SPLIT_KEYS)


def strides(cfg: PrepConfig, **override: int) -> dict[str, int]:
    return {"train": cfg.stride, "val": cfg.stride, "test": 1, **override}


TRAIN = ["train", "val"]


def dropped_series(series: DataFrame, cfg: PrepConfig, rules: DataFrame | None = None) -> DataFrame:
    """Series the length guard of the split leaves out, under the ratios of ``rules`` where it has the dataset."""
    lens, ratio = lengths(series), F.lit(cfg.train_ratio)
    if rules is not None:
        lens = lens.join(rules.select("dataset", "train_ratio"), "dataset", "left")
        ratio = F.coalesce("train_ratio", ratio)
    short = (F.col("n").cast("double") * ratio).cast("bigint") < cfg.seq_len + cfg.pred_len
    return lens.filter(short).drop("train_ratio")


def statistical_samples(
    series: Source, prompts: DataFrame, cfg: PrepConfig = PrepConfig(), splits: list[str] = TRAIN,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Windows whose input is the series' feature vector followed by the values."""
    windows = lookback_windows(series, cfg, splits, strides(cfg), rules, prompts)
    return with_prefix(windows, "prompt").drop("prompt")


def csv_samples(series, prompts, cfg=PrepConfig(), splits=TRAIN, rules=None) -> DataFrame:
    """Older name of ``statistical_samples``."""
    return statistical_samples(series, prompts, cfg, splits, rules)


def text_samples(
    series: Source, dim: DataFrame, cfg: PrepConfig = PrepConfig(), splits: list[str] = TRAIN,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Windows whose input starts with the dataset's class number."""
    windows = lookback_windows(series, cfg, splits, strides(cfg), rules)
    indexed = dataset_index(windows, dim)
    return with_prefix(indexed, F.array(F.col("ds_index").cast("double")))


def token_samples(
    series: Source, prompts: DataFrame, cfg: PrepConfig = PrepConfig(), splits: list[str] = TRAIN,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Windows as tokens: input and label share one scale, the prompt has its own."""
    matched = lookback_windows(series, cfg, splits, strides(cfg), rules, prompts)
    span = cfg.seq_len + cfg.pred_len
    both = tokenise(matched.withColumn("_all", F.concat("x", "y")), "_all", span, "_t", "scale")
    both = tokenise(both, "prompt", span, "_pt", "_ps")
    return both.select(
        *SPLIT_KEYS, "off", F.concat("_pt", F.slice("_t", 1, cfg.seq_len)).alias("x"),
        F.slice("_t", cfg.seq_len + 1, cfg.pred_len).alias("y"), "scale",
    )


def tsf_samples(
    tsf: DataFrame, prompts: DataFrame, cfg: PrepConfig = PrepConfig(), splits: list[str] = TRAIN,
    val_stride: int = 54,
) -> DataFrame:
    """Windows of attribute-header files; prompts are found by series ordinal."""
    windows = lookback_windows(tsf_series(tsf), cfg, splits, strides(cfg, val=val_stride), None, prompts, ordinal_prompts)
    return with_prefix(windows, "prompt").drop("prompt")


def build(
    spark: SparkSession, paths: list[str], kind: str, cfg: PrepConfig = PrepConfig(), splits: list[str] = TRAIN,
    prompts: DataFrame | None = None, dim: DataFrame | None = None, rules: DataFrame | None = None,
) -> DataFrame:
    """Choose reader by file suffix and builder by model kind: statistical, text or token."""
    if not paths[0].endswith(".csv"):
        return tsf_samples(read_tsf(spark, paths), prompts, cfg, splits)
    series = read_wide_csv(spark, paths)
    if kind == "text":
        return text_samples(series, dim, cfg, splits, rules)
    maker: Callable = {"token": token_samples, "statistical": statistical_samples}[kind]
    return maker(series, prompts, cfg, splits, rules)


def batched_splits(samples: DataFrame, batch_size: int, seed: int = 0) -> DataFrame:
    """Shuffled order and batch numbers within the samples of each split."""
    return shuffled_batches(samples, [*KEYS, "off"], batch_size, seed, within=["split"])


def marked_samples(
    series: DataFrame, kind: str = "custom", seq_len: int = 384, pred_len: int = 96, mode: str = "S",
    target: str = "OT", scale: bool = True, time_fields: str = "plain", freq: str = "h", percent: int = 100,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Channel-independent windows with calendar marks of input and label.

    ``kind`` picks the split: ``hour`` and ``quarter`` use calendar borders,
    ``custom``, ``list`` and ``tsf`` the 0.7/0.2 borders, ``whole`` one part that
    is scaled on all rows.
    """
    chosen = select_series(series, mode, target)
    if kind == "whole":
        parts = chosen.withColumn("split", F.lit("all")).withColumn("src_idx", F.col("idx"))
        train = chosen
    elif kind in ("hour", "quarter"):
        per_hour = 4 if kind == "quarter" else 1
        parts = split_calendar(chosen, seq_len, per_hour, percent, keys)
        train = chosen.filter(F.col("idx") < 12 * 30 * 24 * per_hour)
    else:
        parts = split_borders(chosen, seq_len, percent, keys)
        n7 = (F.col("n").cast("double") * 0.7).cast("bigint")
        train = join_groups(chosen, lengths(chosen, keys), keys).filter(F.col("idx") < n7)
    if scale:
        fit, transform, _ = processor("standard_scaler")
        parts = transform(parts, fit(train, keys), keys)
    marks: dict = {}
    if kind in ("hour", "quarter", "custom"):
        ts = F.col("ts")
        marks = plain_fields(ts, kind == "quarter") if time_fields == "plain" else fields_for(freq, ts)
    parts = parts.withColumns(marks) if marks else parts
    return sample_windows(parts, seq_len, pred_len, 1, ["split", *keys], marks=list(marks) or None)


def prediction_inputs(
    series: DataFrame, seq_len: int, pred_len: int, freq: str, mode: str = "S", target: str = "OT",
    scale: bool = True, keys: list[str] = KEYS, time_fields: str = "plain", cols: list[str] | None = None,
    inverse: bool = False,
) -> DataFrame:
    """Last ``seq_len`` points of each series with marks for them and the steps to come.

    ``cols`` names the series wanted, the target among them.  ``time_fields="scaled"`` gives the calendar fields of ``freq``
    between -0.5 and 0.5.  ``inverse`` adds ``x_raw``, the points before scaling.
    """
    if cols is not None:
        if target not in cols:
            raise ValueError(f"the target {target!r} is not among {cols}")
        series = series.filter(F.col("series_id").isin(cols))
    chosen = select_series(series, mode, target)
    tail = prediction_tail(chosen, seq_len, keys).withColumn("_raw", F.col("y"))
    if scale:
        fit, transform, _ = processor("standard_scaler")
        tail = transform(tail, fit(chosen, keys), keys)
    packed = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("p"), F.col("y").alias("v"), F.col("ts").alias("t"), F.col("_raw").alias("r")))).alias("_s")
    )
    raw = [F.col("_s.r").alias("x_raw")] if inverse else []
    packed = packed.select(*keys, F.col("_s.v").alias("x"), F.col("_s.t").alias("x_ts"), *raw)
    out = packed.withColumn("last_ts", F.element_at("x_ts", -1)).withColumn(
        "future_ts", future_timestamps("last_ts", freq, pred_len)
    )
    fields = (lambda ts: plain_fields(ts, True)) if time_fields == "plain" else (lambda ts: fields_for(freq, ts))
    mark = lambda ts: F.array(*[c.cast("double") for c in fields(ts).values()])
    return out.withColumns(
        {"x_mark": F.transform("x_ts", mark), "y_mark": F.transform("future_ts", mark)}
    ).drop("last_ts")
