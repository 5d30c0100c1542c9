"""Series stored once in chunks, so that splitting, scaling and cutting windows read rows where they lie.

A row of a packed table is one chunk of ``size`` consecutive points of a series and the ``halo`` points that follow it, as
arrays, with what every row of the series shares: its length, mean and deviation.  Split edges follow from the length, scaling
from mean and deviation, and every window that starts in a chunk ends in its halo; none of it moves a row.  A chunk is bounded
however long the series is, so a hot series is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import KEYS, PACK_BLOCK, PACK_CHUNK, PACK_HALO, bound
from tidegauge.functions.names import clean_name
from tidegauge.operators.order import profile, rank_within, running_sum
from tidegauge.operators.scaling import fit_scaler
from tidegauge.session import stored

Bounds = dict[str, tuple[Column, Column]]


@dataclass(frozen=True)
class Packed:
    """A packed table: ``keys, chunk, n, mean, scale, ys`` and, if the series had it, ``ts``."""

    chunks: DataFrame
    size: int
    halo: int
    keys: tuple[str, ...] = tuple(KEYS)

    def series(self) -> DataFrame:
        """One row per series: keys, n, mean, scale (and what was added); the arrays are not read."""
        return self.chunks.filter(F.col("chunk") == 0).drop("chunk", "ys", "ts")

    def rows(self, columns: tuple[str, ...] = ("ys",)) -> DataFrame:
        """The points again, one row each: keys, idx and ``y`` (or ``y`` and ``ts``)."""
        own = [F.slice(c, 1, self.size).alias(c) for c in columns]
        flat = self.chunks.select(*self.keys, "chunk", F.posexplode(F.arrays_zip(*own)).alias("_p", "_r"))
        names = {"ys": "y"}
        return flat.select(*self.keys, (F.col("chunk") * self.size + F.col("_p")).alias("idx"), *[F.col(f"_r.{c}").alias(names.get(c, c)) for c in columns])


def packed_rows(series: DataFrame, size: int, halo: int, keys: list[str] = KEYS) -> DataFrame:
    """The chunks of a long series table, from one exchange of its points by (series, chunk).

    Totals are aggregated beside it and repeated per chunk, so that no task joins all points of a series.
    """
    if halo > size:
        raise ValueError(f"the halo of {halo} points is larger than a chunk of {size}")
    std = F.stddev_pop("y")
    totals = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"))
    totals = totals.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {size}"))))
    own = F.expr(f"idx div {size}")
    placed = series.withColumn("chunk", F.explode(F.array_compact(F.array(own, F.when((F.col("idx") % size < halo) & (own > 0), own - 1)))))
    fields = [F.col("idx").alias("p"), F.col("y").alias("ys")] + ([F.col("ts").alias("ts")] if "ts" in series.columns else [])
    shared = [*keys, "chunk", "n", "mean", "scale"]
    packed = placed.join(totals, [*keys, "chunk"]).groupBy(*shared).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    return packed.select(*shared, *[F.col(f"_s.{f}").alias(f) for f in ("ys", "ts") if f == "ys" or "ts" in series.columns])


def pack(series: DataFrame, span: int = 0, keys: list[str] = KEYS, path: str | None = None) -> Packed:
    """Stores a long series table in chunks, in ``path`` or in the shared scratch folder; windows of ``span`` points are served.

    Positions must run from 0 without holes, as the readers make them.
    """
    spark = series.sparkSession
    halo = max(bound(spark, PACK_HALO), span - 1, 0)
    size = max(bound(spark, PACK_CHUNK), halo)
    rows = packed_rows(series, size, halo, keys).withColumns({"size": F.lit(size), "halo": F.lit(halo)})
    if path is None:
        chunks = stored(rows, "packed-series")
    else:
        rows.write.parquet(path)
        chunks = spark.read.schema(rows.schema).parquet(path)
    return Packed(chunks.drop("size", "halo"), size, halo, tuple(keys))


def open_packed(spark: SparkSession, path: str, keys: list[str] = KEYS) -> Packed:
    """A packed table written before."""
    chunks = spark.read.parquet(path)
    shape = chunks.select("size", "halo").first()
    if shape is None:
        return Packed(chunks.drop("size", "halo"), 1, 1, tuple(keys))
    return Packed(chunks.drop("size", "halo"), shape["size"], shape["halo"], tuple(keys))


def fit_prefix(packed: Packed, end: Column | int) -> DataFrame:
    """Scaler of the first ``end`` points of every series (``end`` may use ``n``)."""
    inside = F.least(F.col("n"), end if isinstance(end, Column) else F.lit(end)) - F.col("chunk") * packed.size
    taken = F.least(inside, F.lit(packed.size).cast("bigint")).cast("int")
    some = packed.chunks.withColumn("_k", taken).filter("_k > 0").select(*packed.keys, F.explode(F.slice("ys", 1, F.col("_k"))).alias("y"))
    return fit_scaler(some, list(packed.keys))


def _parts(packed: Packed, bounds: Bounds, stride: dict[str, int], span: int) -> Column:
    """Splits of a chunk in which a window starts: name, stride, and the first and last offset within the split."""
    begin = F.col("chunk") * packed.size
    out = []
    for name, (lo, hi) in bounds.items():
        lo = F.greatest(lo.cast("bigint"), F.lit(0).cast("bigint"))
        step = F.lit(stride[name]).cast("bigint")
        ahead = F.greatest(begin - lo, F.lit(0).cast("bigint"))
        first = ahead + F.pmod(-ahead, step)
        last = F.least(F.least(hi.cast("bigint"), F.col("n")) - lo - span, begin + packed.size - 1 - lo)
        out.append(F.struct(F.lit(name).alias("split"), lo.alias("lo"), step.alias("step"), first.alias("first"), last.alias("last")))
    return F.filter(F.array(*out), lambda e: e["first"] <= e["last"])


def packed_windows(
    packed: Packed, bounds: Bounds, seq_len: int, pred_len: int, stride: dict[str, int], guard: Column | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None, params: DataFrame | None = None, scaled: bool = True,
    marks: dict[str, Column] | None = None,
) -> DataFrame:
    """Every ``stride``-th (input, label) pair of the given splits, straight from the chunks.

    ``bounds`` are written in terms of ``n``; series that fail ``guard`` are left out.  ``params`` (keys, mean, scale) replaces
    the stored mean and deviation.  ``attach`` may join further columns; it sees one row per (split, chunk) that has windows.
    ``marks`` are columns made from ``ts``.
    """
    span = seq_len + pred_len
    if span - 1 > packed.halo:
        raise ValueError(f"windows of {span} points need a halo of {span - 1}; the table has {packed.halo}")
    chunks = packed.chunks if guard is None else packed.chunks.filter(guard)
    if params is not None:
        chunks = chunks.drop("mean", "scale").join(params, list(packed.keys))
    rows = chunks.withColumn("_e", F.explode(_parts(packed, bounds, stride, span))).withColumn("split", F.col("_e.split"))
    if attach:
        rows = attach(rows)
    carried = [c for c in rows.columns if c not in (*packed.chunks.columns, "_e", "split")]
    v = F.transform("ys", lambda y: (y - F.col("mean")) / F.col("scale")) if scaled else F.col("ys")
    arrays = [v.alias("_v")]
    if marks:
        arrays.append(F.transform("ts", lambda t: F.array(*[m(t).cast("double") for m in marks.values()])).alias("_m"))
    offs = rows.select(
        *packed.keys, "split", *carried, *arrays, (F.col("chunk") * packed.size - F.col("_e.lo")).alias("_b"),
        F.explode(F.sequence(F.col("_e.first"), F.col("_e.last"), F.col("_e.step"))).alias("off"))
    begin = (F.col("off") - F.col("_b")).cast("int") + 1
    out = ["split", *packed.keys, "off", F.slice("_v", begin, seq_len).alias("x"), F.slice("_v", begin + seq_len, pred_len).alias("y"), *carried]
    if marks:
        out += [F.slice("_m", begin, seq_len).alias("x_mark"), F.slice("_m", begin + seq_len, pred_len).alias("y_mark")]
    return offs.select(*out)


def wanted_keys(packed: Packed, bounds: Bounds, span: int, guard: Column | None = None) -> DataFrame:
    """(split, keys, lo, hi) of every split that holds a window; one row per series and split."""
    series = packed.series() if guard is None else packed.series().filter(guard)
    each = F.array(*[F.struct(F.lit(name).alias("split"), F.greatest(lo.cast("bigint"), F.lit(0).cast("bigint")).alias("lo"), F.least(
        hi.cast("bigint"), F.col("n")).alias("hi")) for name, (lo, hi) in bounds.items()])
    return series.withColumn("_e", F.explode(each)).select("_e.*", *packed.keys).filter(F.col("hi") - F.col("lo") >= span)


def named_prompts(prompts: DataFrame) -> DataFrame:
    """split, dataset, _name, prompt; prompts whose cleaned names meet raise when they are read."""
    right = prompts.select("split", "dataset", clean_name(F.col("series_id")).alias("_name"), F.col("features").alias("prompt"))
    twice = F.raise_error(F.concat_ws(" ", F.lit("several prompts have the cleaned name"), "dataset", "_name"))
    return right.groupBy("split", "dataset", "_name").agg(F.first("prompt").alias("_p"), F.count(F.lit(1)).alias("_c")).select(
        "split", "dataset", "_name", F.when(F.col("_c") > 1, twice.cast("array<double>")).otherwise(F.col("_p")).alias("prompt"))


def keyed_prompts(keys: DataFrame, prompts: DataFrame) -> DataFrame:
    """``keys`` with the vector of their split and cleaned name; NULL where there is none."""
    named = keys.withColumn("_name", clean_name(F.col("series_id")))
    return named.join(named_prompts(prompts), ["split", "dataset", "_name"], "left").drop("_name")


def ordinal_prompts(keys: DataFrame, prompts: DataFrame) -> DataFrame:
    """``keys`` with the vector of the series of the same number, ``T1`` being the first; NULL where there is none."""
    ordinal = F.expr("cast(substr(series_id, 2) as bigint) - 1")
    right = prompts.select("dataset", ordinal.alias("_o"), F.col("features").alias("prompt"))
    return keys.withColumn("_o", ordinal).join(right, ["dataset", "_o"], "left").drop("_o")


def prompt_blocks(packed: Packed, found: DataFrame, on_missing: str = "raise") -> Callable[[DataFrame], DataFrame]:
    """Joins vectors to chunks by (split, series, block of chunks); a vector is repeated once per block its split reaches.

    ``found`` has (split, keys, lo, hi, prompt), one row per series and split.  A chunk whose split has no vector raises, or
    is left out with ``on_missing="drop"``.
    """
    if on_missing not in ("raise", "drop"):
        raise ValueError("on_missing must be raise or drop")
    step = bound(packed.chunks.sparkSession, PACK_BLOCK)
    keys = ["split", *packed.keys]
    block = f"div {packed.size * step}"
    right = found.filter(F.col("prompt").isNotNull()).select(
        *keys, F.explode(F.sequence(F.expr(f"lo {block}"), F.expr(f"(hi - 1) {block}"))).alias("_block"), "prompt")
    none = F.raise_error(F.concat(F.lit("no prompt for "), F.concat_ws(" / ", *keys))).cast("array<double>")

    def attach(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("_block", F.expr(f"chunk div {step}"))
        if on_missing == "drop":
            return own.join(right, [*keys, "_block"]).drop("_block")
        return own.join(right, [*keys, "_block"], "left").drop("_block").withColumn("prompt", F.coalesce("prompt", none))

    return attach


def numbered(packed: Packed, bounds: Bounds, span: int, stride: dict[str, int], guard: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Joins to every chunk the number of its split's first sample, all samples counted in (split, series, offset) order.

    Lengths give the samples of a series, so only the table of one row per split and series is ranked and summed; it meets the
    chunks by (split, series, block of chunks), and windows get ``sample_id`` as ``first_sample + off div stride`` where they lie.
    """
    keys = ["split", *packed.keys]
    chain = F.coalesce(*[F.when(F.col("split") == name, F.lit(step).cast("bigint")) for name, step in stride.items()])
    per = wanted_keys(packed, bounds, span, guard).withColumn("_n", F.floor((F.col("hi") - F.col("lo") - span) / chain) + 1)
    prof = profile(per, [])
    ranked = rank_within(per, [], keys, "_r", prof).withColumn("_all", F.lit(0))
    sums = running_sum(ranked, ["_all"], "_r", {"_upto": F.col("_n")}, prof)
    step = bound(packed.chunks.sparkSession, PACK_BLOCK)
    block = f"div {packed.size * step}"
    right = sums.select(*keys, F.explode(F.sequence(F.expr(f"lo {block}"), F.expr(f"(hi - 1) {block}"))).alias("_block"), (
        F.col("_upto") - F.col("_n")).alias("first_sample"))

    def attach(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_block", F.expr(f"chunk div {step}")).join(right, [*keys, "_block"]).drop("_block")

    return attach


def numbered_windows(packed: Packed, bounds: Bounds, seq_len: int, pred_len: int, stride: dict[str, int], **options) -> DataFrame:
    """Windows with ``sample_id``, their place among all samples in (split, series, offset) order."""
    attach = numbered(packed, bounds, seq_len + pred_len, stride, options.get("guard"))
    out = packed_windows(packed, bounds, seq_len, pred_len, stride, attach=attach, **options)
    step = F.coalesce(*[F.when(F.col("split") == name, F.lit(s).cast("bigint")) for name, s in stride.items()])
    return out.withColumn("sample_id", F.col("first_sample") + F.floor(F.col("off") / step)).drop("first_sample")
