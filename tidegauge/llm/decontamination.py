"""Benchmark decontamination with DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words are
maximal runs of ASCII letters and digits and non-ASCII characters, A-Z folded. The hashes of all windows form a set that
travels with the plan. The longest word of each window is its anchor: windows of a document around an anchor are tested
against the set, and what it lets through is compared word by word. A set beyond ``inline_windows`` does not fit a plan: then document windows are joined to it instead.

NULL and empty texts have no words and no hits; NULL items have no windows; repeated rows are judged one by one; an empty
table on either side gives no hits. Columns of the input are kept, whatever their names: new columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.columns import shielded
from tidegauge.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HITS = "array<struct<start:int,length:int,window:string>>"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; ``lower`` is used where it can only touch A-Z, as it is much faster."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), BETWEEN), "")


def windows_of(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct (window, length, hash, item_id); a window is its words with blanks between."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", "w", F.least(F.size("w"), F.lit(size)).alias("length")).select(
        "item_id", "length",
        F.explode(F.expr("transform(sequence(0, size(w) - length), i -> slice(w, i + 1, length))")).alias("w"))
    return cut.select("item_id", "length", F.concat_ws(" ", "w").alias("window"), F.xxhash64("w").alias("hash")).distinct()


def _numbers(values: list[int]) -> str:
    return ", ".join("-9223372036854775807L - 1" if v == -(1 << 63) else f"{v}L" for v in values)


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def find(docs: DataFrame, items: DataFrame, size: int = 10, inline_windows: int = 50_000) -> DataFrame:
    """``docs`` with ``_n_words`` and ``_hits``, an array of (start, length, window) in order of start."""
    windows = windows_of(items, size).select("window", "length", "hash").distinct()
    known = windows.limit(inline_windows + 1).collect()  # bounded; more than that is never brought here
    if len(known) <= inline_windows:
        return _find_inline(docs, known)
    return _find_by_join(docs, windows)


def _counted(docs: DataFrame) -> DataFrame:
    w = docs.withColumn("_words", words_of(F.col("text")))
    return w.withColumn("_n_words", F.size("_words").cast("bigint"))


def _find_inline(docs: DataFrame, known) -> DataFrame:
    w = _counted(docs)
    if not known:
        return w.withColumn("_hits", F.expr(f"cast(array() as {_HITS})")).drop("_words")
    anchors = sorted({max(k["window"].split(" "), key=lambda x: (len(x), x)) for k in known})
    w = w.withColumn("_spots", F.expr(
        f"filter(transform(_words, (w, i) -> if(w in ({_texts(anchors)}), i, null)), i -> i is not null)"))
    tests = []
    for length in sorted({k["length"] for k in known}):
        own = [k for k in known if k["length"] == length]
        part = f"slice(_words, i + 1, {length})"
        starts = f"array_distinct(flatten(transform(_spots, p -> sequence(greatest(p - {length - 1}, 0), p))))"
        tests.append(
            f"transform(filter(filter({starts}, i -> i <= size(_words) - {length} and "
            f"xxhash64({part}) in ({_numbers([k['hash'] for k in own])})), "
            f"i -> concat_ws(' ', {part}) in ({_texts([k['window'] for k in own])})), "
            f"i -> struct(i as start, {length} as length, concat_ws(' ', {part}) as window))")
    hits = f"if(size(_spots) = 0, cast(array() as {_HITS}), array_sort(concat({', '.join(tests)})))"
    # A filter on ``_hits`` must stay above it: moved below, it would hold the splitting of the text inside the lambdas, once
    # per word. Spark moves no filter through a projection that holds a value bound to the row's place.
    return w.withColumn("_hits", F.when(F.monotonically_increasing_id() >= 0, F.expr(hits))).drop("_words", "_spots")


def _find_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``size`` numbers
    spots = F.flatten(F.array(*[
        F.expr(f"if(size(_words) >= {n}, transform(sequence(0, greatest(size(_words) - {n}, 0)), "
               f"i -> struct(i as start, {n} as length, xxhash64(slice(_words, i + 1, {n})) as hash, "
               f"concat_ws(' ', slice(_words, i + 1, {n})) as window)), "
               "cast(array() as array<struct<start:int,length:int,hash:bigint,window:string>>))") for n in sorted(lengths)]))
    exploded = _counted(numbered.select("_row", "text")).select("_row", F.inline(spots))
    found = exploded.join(windows, ["hash", "length", "window"]).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "window"))).alias("_hits"))
    none = F.expr(f"cast(array() as {_HITS})")
    return (_counted(numbered).drop("_words").join(found, "_row", "left")
            .withColumn("_hits", F.coalesce("_hits", none)).drop("_row"))


def n_hit() -> Column:
    """Words covered by the hits: overlapping windows count once."""
    return F.expr(
        "aggregate(_hits, struct(0 as reach, 0L as total), (a, h) -> struct(greatest(a.reach, h.start + h.length) as reach, "
        "a.total + greatest(0, h.start + h.length - greatest(h.start, a.reach)) as total), a -> a.total)")


def report(docs: DataFrame, items: DataFrame, size: int = 10, inline_windows: int = 50_000) -> DataFrame:
    """One row per document: words, words hit, items met and whether it is contaminated."""
    found = find(docs.select("doc_id", "text"), items, size, inline_windows)
    rows = found.withColumn("_row", F.monotonically_increasing_id()).select(
        F.col("_row").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.explode_outer(F.array_distinct(F.expr("transform(_hits, h -> h.window)"))).alias("window"))
    names = windows_of(items, size).select("window", "item_id").distinct()
    met = (rows.join(names, "window", "left").groupBy("row")
           .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"),
                F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return met.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, size: int = 10, inline_windows: int = 50_000) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    own, names = shielded(docs, "text")
    return find(own, items, size, inline_windows).where(F.size("_hits") == 0).select(*names)


def remove_spans(docs: DataFrame, items: DataFrame, size: int = 10, inline_windows: int = 50_000) -> DataFrame:
    """All documents; those with hits lose the words covered, their remaining words joined by blanks."""
    own, names = shielded(docs, "text")
    found = find(own, items, size, inline_windows)
    kept = F.expr("filter(_words, (w, i) -> not exists(_hits, h -> i >= h.start and i < h.start + h.length))")
    text = F.when(F.size("_hits") > 0, F.concat_ws(" ", kept)).otherwise(F.col("text"))
    return found.withColumn("_words", words_of(F.col("text"))).withColumn("text", text).select(*names)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i + 1, i + least(len(w), 10)) AS x
  FROM b, unnest(range(0, len(w) - least(len(w), 10) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT r, n, i, list_slice(w, i + 1, i + n) AS x FROM d, lens, unnest(range(0, len(w) - n + 1)) t(i) WHERE len(w) >= n),
hits AS (SELECT s.r, s.i, s.n, win.item_id FROM spots s JOIN win ON s.n = win.n AND s.x = win.x),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY r),
met AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN met USING (r)"""
