"""Registry of queries and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Added before rounding on both sides: averages of cents often end exactly in a
# rounding half, where engines may differ in the last bit.
NUDGE = 1.23e-7


def add(name: str, fn: Callable, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is already registered")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None = None):
    def register(fn):
        add(fn.__name__, fn, sql)
        return fn

    return register


def rnd(col: Column | str, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + NUDGE * 10.0 ** (6 - digits), digits)


def r(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + {NUDGE * 10.0 ** (6 - digits)!r}, {digits})"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def unroll(df: DataFrame, keys: list[str], array: str, digits: int = 6) -> DataFrame:
    """Array elements as rows (keys, pos, value)."""
    return df.select(*keys, F.posexplode(array).alias("pos", "value")).withColumn("value", rnd("value", digits))


# Series in SQL, as ``tidegauge.sources.tables`` makes them.
EV = """ev AS (
  SELECT 'events' AS dataset, CAST(user_id AS VARCHAR) AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, value AS y
  FROM events)"""
LI = """li AS (
  SELECT 'lineitem' AS dataset, CAST(l_suppkey AS VARCHAR) AS series_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx,
         l_shipdate AS ts, l_extendedprice AS y
  FROM lineitem)"""
OD = """od AS (
  SELECT 'orders' AS dataset, o_orderpriority AS series_id,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS idx,
         o_orderdate AS ts, total AS y
  FROM (SELECT o_orderpriority, o_orderdate, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY 1, 2))"""
EM = """em AS (
  SELECT 'embeddings' AS dataset, CAST(vec_id AS VARCHAR) AS series_id,
         unnest(range(0, len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS y
  FROM embeddings)"""


def splits_sql(src: str, train: str, val: str, seq: int, guard: int | None, name: str = "sp") -> str:
    """Look-back split of a series CTE."""
    where = f"WHERE CAST(trunc(n * {train}) AS BIGINT) >= {guard}" if guard is not None else ""
    return f"""
len_{name} AS (SELECT dataset, series_id, count(*) AS n FROM {src} GROUP BY 1, 2),
edge_{name} AS (
  SELECT *, CAST(trunc(n * {train}) AS BIGINT) AS nt, CAST(trunc(n * {val}) AS BIGINT) AS nv
  FROM len_{name} {where}),
{name} AS (
  SELECT s.dataset, s.series_id, e.split, s.idx - e.lo AS idx, s.idx AS src_idx, s.ts, s.y
  FROM {src} s JOIN (
    SELECT dataset, series_id, 'train' AS split, 0 AS lo, nt AS hi FROM edge_{name}
    UNION ALL SELECT dataset, series_id, 'val', greatest(nt - {seq}, 0), nt + nv FROM edge_{name}
    UNION ALL SELECT dataset, series_id, 'test', greatest(nt + nv - {seq}, 0), n FROM edge_{name}) e
  ON s.dataset = e.dataset AND s.series_id = e.series_id AND s.idx >= e.lo AND s.idx < e.hi)"""


def windows_sql(src: str, keys: str, seq: int, pred: int, stride: int, name: str = "w") -> str:
    """(x, y) lists of every ``stride``-th window of a series CTE."""
    k = ", ".join(f"s.{c}" for c in keys.split(", "))
    on = " AND ".join(f"s.{c} = o.{c}" for c in keys.split(", "))
    return f"""
n_{name} AS (SELECT {keys}, count(*) AS n FROM {src} GROUP BY {keys}),
o_{name} AS (SELECT {keys}, unnest(range(0, n - {seq + pred} + 1, {stride})) AS off
           FROM n_{name} WHERE n >= {seq + pred}),
{name} AS (
  SELECT {k}, o.off,
         list(s.y ORDER BY s.idx) FILTER (WHERE s.idx < o.off + {seq}) AS x,
         list(s.y ORDER BY s.idx) FILTER (WHERE s.idx >= o.off + {seq}) AS y
  FROM {src} s JOIN o_{name} o ON {on} AND s.idx >= o.off AND s.idx < o.off + {seq + pred}
  GROUP BY {k}, o.off)"""
