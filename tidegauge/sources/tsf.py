"""Attribute-header series files: ``@`` header, then ``attr:...:v1,v2,?`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.functions.names import dataset_of
from tidegauge.sources.files import drop_missing, register_reader

# Bytes 0x80 to 0x9F as code page 1252 assigns them; five are unassigned.
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
LATIN = "".join(chr(b) for b in range(0x80, 0xA0))
TRUE_WORDS = ["y", "yes", "t", "true", "on", "1"]
FALSE_WORDS = ["n", "no", "f", "false", "off", "0"]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stripped, non-empty, non-comment lines with their place in the file."""
    raw = (
        spark.read.option("sep", "\u0001").option("quote", "").option("encoding", "ISO-8859-1")
        .schema("value string").csv(paths)
    )
    line = F.translate(F.regexp_replace("value", r"^\s+|\s+$", ""), LATIN, CP1252)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        line.alias("line"),
    ).filter((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))


def _headers(spark: SparkSession, paths: list[str], lines: DataFrame) -> DataFrame:
    """One row per file: attributes in order, settings, and what is wrong with it."""
    at = F.struct("_blk", "_mid")
    word = F.split("line", " ")
    is_meta = F.startswith(F.col("line"), F.lit("@"))
    marked = lines.select(
        "path", at.alias("at"), word.alias("w"), is_meta.alias("meta"),
        F.startswith(F.col("line"), F.lit("@data")).alias("data"),
        F.startswith(F.col("line"), F.lit("@attribute")).alias("attr"),
    )
    size = F.when(F.col("attr"), F.lit(3)).otherwise(F.lit(2))
    bad = F.col("meta") & ~F.col("data") & (F.size("w") != size)

    def setting(tag):
        return F.max_by(F.get("w", F.lit(1)), F.when(F.startswith(F.get("w", F.lit(0)), F.lit(tag)), F.col("at")))

    def flag(col):
        low = F.lower(col)
        return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))

    body = F.when(~F.col("meta"), F.col("at"))
    heads = marked.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("attr") & ~bad, F.struct(
            "at", F.col("w")[1].alias("name"), F.get("w", F.lit(2)).alias("type"))))).alias("attrs"),
        F.max(bad).alias("bad_meta"),
        F.min(F.when(F.col("data"), F.col("at"))).alias("data_at"),
        F.min(body).alias("body_at"),
        F.min(F.when(F.col("attr"), F.col("at"))).alias("attr_at"),
        setting("@frequency").alias("freq"),
        setting("@horizon").alias("_h"), setting("@missing").alias("_m"), setting("@equallength").alias("_e"),
    )
    error = (
        F.when(F.col("bad_meta"), "a header line has too few or too many fields")
        .when(F.size("attrs") == 0, "no attribute is declared")
        .when(F.col("data_at") < F.col("attr_at"), "attributes are declared after the data mark")
        .when(F.col("data_at").isNull() & F.col("body_at").isNotNull(), "series lines stand before any data mark")
        .when(F.col("body_at") < F.col("data_at"), "series lines stand before any data mark")
        .when(F.col("body_at").isNull(), "no series line follows the data mark")
    )
    heads = heads.select(
        "path", "attrs", "freq", F.expr("try_cast(_h as int)").alias("horizon"),
        flag(F.col("_m")).alias("has_missing"), flag(F.col("_e")).alias("equal_length"), error.alias("error"),
    )
    # A file without lines shows only in the listing, which the reader holds anyway.
    listed = spark.read.format("binaryFile").load(paths).inputFiles()
    files = spark.createDataFrame([(p,) for p in listed], "path string").select(_plain("path").alias("p"))
    empty = F.when(F.col("attrs").isNull(), F.lit("the file has no content")).otherwise(F.col("error"))
    named = heads.withColumn("p", _plain("path")).drop("path")
    return files.join(named, "p", "left").withColumn("error", empty)


def _plain(path: str):
    """Local paths in one spelling."""
    return F.regexp_replace(path, r"^file:/+", "/")


def read_tsf(
    spark: SparkSession, paths: str | list[str], mode: str = "strict"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Series of attribute-header files, one row per data line.

    Columns: ``dataset, ordinal, attrs, attr_types, freq, horizon, has_missing,
    equal_length, series_value``; a missing value is NULL.  ``strict`` raises on
    a line with the wrong number of fields; ``lenient`` leaves such lines out and
    also returns them as a second table.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError("mode must be strict or lenient")
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _lines(spark, paths)
    heads = _headers(spark, paths, lines)
    wrong = heads.filter(F.col("error").isNotNull()).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['p']}: {wrong[0]['error']}")
    body = lines.filter(~F.startswith(F.col("line"), F.lit("@"))).select(
        _plain("path").alias("p"), "_blk", "line", F.monotonically_increasing_id().alias("_at"))
    # Headers hold one row per file, so Spark joins them by broadcast when they are small.
    heads = heads.drop("error")
    rows = body.join(heads, "p").withColumn("_f", F.split("line", ":"))
    fits = F.size("_f") == F.size("attrs") + 1
    rejected = rows.filter(~fits).select(dataset_of(paths, F.col("p")).alias("dataset"), "line")
    if mode == "lenient":
        rows = rows.filter(fits)
    rows = _numbered(rows, body, heads, mode == "lenient")
    values = F.split(F.element_at("_f", -1), ",")
    number = F.transform(values, lambda v: F.when(v == "?", F.lit(None)).otherwise(F.trim(v).cast("double")))
    missing = F.forall(values, lambda v: v == "?")
    pairs = F.zip_with("attrs", F.slice("_f", 1, F.size("attrs")), lambda a, v: F.struct(
        a["name"].alias("name"), a["type"].alias("type"), v.alias("v")))
    fail = lambda text: F.raise_error(F.lit(text))
    kinds = ["numeric", "string", "date"]
    bad_kind = F.exists("_pairs", lambda p: ~p["type"].isin(kinds))
    good_value = lambda p: (
        F.when(p["type"] == "numeric", F.trim(p["v"]).rlike(r"^[+-]?\d+$"))
        .when(p["type"] == "date", F.try_to_timestamp(p["v"], F.lit("yyyy-MM-dd HH-mm-ss")).isNotNull())
        .otherwise(F.lit(True))
    )
    checked = (
        F.when(~fits, fail("a series line has the wrong number of fields"))
        .when(missing, fail("a series line has only missing values"))
        .when(bad_kind, fail("an attribute has an unknown type"))
        .when(~F.forall("_pairs", good_value), fail("an attribute value does not suit its type"))
        .otherwise(number)
    )
    rows = rows.withColumn("_pairs", F.when(fits, pairs))
    parsed = rows.select(
        dataset_of(paths, F.col("p")).alias("dataset"), "ordinal",
        F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["name"], p["v"]))).alias("attrs"),
        F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["name"], p["type"]))).alias("attr_types"),
        "freq", "horizon", "has_missing", "equal_length", checked.alias("series_value"),
    )
    parsed = parsed.select(*[c for c in parsed.columns if c != "ordinal"], "ordinal")
    return (parsed, rejected) if mode == "lenient" else parsed


def _numbered(rows: DataFrame, body: DataFrame, heads: DataFrame, lenient: bool) -> DataFrame:
    """``ordinal``: the place of a series line among the lines of its file that are kept.

    Lines of one block of a file are numbered one after the other, so a line's place is that in its block and the lines of the
    blocks before; these follow from one row per block.  No line is sorted or moved for it.
    """
    own = ["p", "_blk"]
    blocks = body.groupBy(*own).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    gone = F.lit(0)
    if lenient:
        slim = body.select(*own, "_at", F.size(F.split("line", ":")).alias("_k")).join(heads.select("p", F.size("attrs").alias("_a")), "p")
        bad = slim.filter("_k <> _a + 1").groupBy(*own).agg(F.sort_array(F.collect_list("_at")).alias("_bad"))  # of one block
        blocks = blocks.join(bad, own, "left")
        gone = F.coalesce(F.size("_bad"), F.lit(0))
        gone = F.greatest(gone, F.lit(0))
    before = Window.partitionBy("p").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum(F.col("_n") - gone).over(before), F.lit(0)))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    if lenient:
        place = place - F.greatest(F.coalesce(F.size(F.filter("_bad", lambda x: x < F.col("_at"))), F.lit(0)), F.lit(0))
    return rows.join(blocks.drop("_n"), own).withColumn("ordinal", place.cast("bigint")).drop("_blk", "_at", "_first", "_before", "_bad")


def numeric_attr(name: str):
    return F.col("attrs")[name].cast("bigint")


def date_attr(name: str):
    return F.to_timestamp(F.col("attrs")[name], "yyyy-MM-dd HH-mm-ss")


def tsf_series(tsf: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Long series table; series are named T1, T2, ... in file order."""
    long = tsf.select(
        "dataset", F.concat(F.lit("T"), (F.col("ordinal") + 1).cast("string")).alias("series_id"),
        F.posexplode("series_value").alias("idx", "y"),
    ).select(*KEYS, F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast("timestamp_ntz").alias("ts"), "y")
    return long if keep_missing else drop_missing(long)


register_reader("monash", lambda spark, paths: tsf_series(read_tsf(spark, paths)))
