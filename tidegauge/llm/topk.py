"""Exact top-k inner products through a pivot-distance index.

One more component makes all vectors equally long, so a larger inner product is a smaller distance. Every vector is keyed by
its nearest pivot and its distance to it; sorted by that key, vectors are cut into blocks, each an annulus around a pivot.
Queries, cut into blocks the same way, first search the annuli nearest to them; the k-th score found so bounds what is left:
an annulus is opened only if the triangle inequality (or the product of norms) allows a better score for any query of the
block. Scores are integers and computed exactly; bounds have a margin for rounding.

Pivots come from a bounded sample of vectors and only steer the work. The block list has at most about ``most_blocks`` rows.
Vectors that are NULL, or hold NULL or non-finite components, take no part. Vectors of unequal length are compared over the
components that both have. A component or a score beyond 64 bits raises. Ties go to the smaller id; equal ids are ranked in
any order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import stored


def cleaned(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """(id, v): the usable vectors as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint")
    whole = F.transform(v, lambda x: F.when(F.abs(x * factor) < 2.0**63, F.floor(x * factor)).otherwise(wide))
    return vectors.where(usable).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers, one vector a row."""
    at = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    if len(at) and (at == dims).all():
        return flat.reshape(len(at), dims)
    out = np.zeros((len(at), dims), np.int64)
    row = np.repeat(np.arange(len(at)), at)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


def _raised(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes their squared length ``longest``."""
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal from the row nearest to the mean."""
    if not len(sample):
        return sample
    first = int(((sample - sample.mean(0)) ** 2).sum(1).argmin())
    picked, least = [first], ((sample - sample[first]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)):
        far = int(least.argmax())
        if least[far] <= 0:
            break
        picked.append(far)
        least = np.minimum(least, ((sample - sample[far]) ** 2).sum(1))
    return sample[picked]


_BLOCK = "block bigint, pivot int, near double, far double, norm double, ids binary, v binary, rows int"


def _blocks(keyed: DataFrame, dims: int, size: int, kind: str) -> DataFrame:
    """Rows of a sorted partition, ``size`` at a time, as one row with a matrix of integers of ``kind``."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept, rows = [], 0

        def cut(table):
            nonlocal number
            table = table.combine_chunks()
            pivot = table.column("pivot").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for a in range(lo, hi, size):
                    part = table.slice(a, min(size, hi - a))
                    x = _matrix(part.column("v").combine_chunks(), dims)
                    d = part.column("d").to_numpy()
                    yield pa.RecordBatch.from_pylist([{
                        "block": number, "pivot": int(pivot[a]), "near": float(d.min()), "far": float(d.max()),
                        "norm": float(np.sqrt((x.astype(float) ** 2).sum(1).max())), "ids": part.column("id").to_numpy().tobytes(),
                        "v": x.astype(kind).tobytes(), "rows": len(x)}], schema)
                    number += 1

        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("norm", pa.float64()),
                            ("ids", pa.binary()), ("v", pa.binary()), ("rows", pa.int32())])
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= 4 * size:
                yield from cut(pa.Table.from_batches(kept))
                kept, rows = [], 0
        if rows:
            yield from cut(pa.Table.from_batches(kept))

    return keyed.mapInArrow(work, _BLOCK)


def _compare(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; no part of a sum is larger than the product of the norms."""
    a, b = q.astype(float), v.astype(float)
    reach = float(np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0)))
    if reach < 1 << 24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if reach < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if reach < 1 << 62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = q.astype(object) @ v.astype(object).T
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def _search(pairs: DataFrame, data: DataFrame, queries: DataFrame, dims: int, k: int, kind: str) -> DataFrame:
    """The k best of every query in each pair of blocks, as (query_id, vec_id, score)."""
    q = queries.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    both = pairs.join(q, "q").join(data.select("block", "ids", "v"), "block").select("q_ids", "q_v", "floor", "ids", "v")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qi, vi = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                qx, vx = np.frombuffer(row["q_v"], kind).reshape(len(qi), dims), np.frombuffer(row["v"], kind).reshape(len(vi), dims)
                floor = np.frombuffer(row["floor"], np.int64)
                score = _compare(qx, vx)
                at, to = np.nonzero((score >= floor[:, None]) & (qi[:, None] != vi[None]))
                s = score[at, to]
                order = np.lexsort((vi[to], -s, at))
                at, to, s = at[order], to[order], s[order]
                start = np.searchsorted(at, at)
                keep = np.arange(len(at)) - start < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[at[keep]]), pa.array(vi[to[keep]]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

    return both.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 64.0,
           pivots: int = 32, sample: int = 4096, block: int = 2048, most_blocks: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best other rows of every row for which ``is_query`` (a condition on id) holds."""
    spark = vectors.sparkSession
    rows = stored(cleaned(vectors, id_col, vector_col, factor), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("longest"), F.max(F.aggregate(
            "v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))).alias("widest")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not shape["n"]:
        return empty
    dims, longest = max(1, shape["dims"]), shape["longest"]
    kind = "<i4" if shape["widest"] < 1 << 31 else "<i8"  # as narrow as the numbers allow
    some = rows.where(F.rand(9) < min(1.0, sample / shape["n"])).limit(2 * sample).toArrow()
    fitted = choose_pivots(_raised(_matrix(some.column("v").combine_chunks(), dims), longest), pivots)
    if not len(fitted):
        fitted = np.zeros((1, dims + 1))
    shared = spark.sparkContext.broadcast((fitted, longest, dims))
    size = max(block, -(-shape["n"] // most_blocks))

    def key(batches):
        fitted, longest, dims = shared.value
        for batch in batches:
            if batch.num_rows:
                d = _distances(_raised(_matrix(batch.column(1), dims), longest), fitted)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["id", "v", "pivot", "d"])

    keyed = stored(rows.mapInArrow(key, "id bigint, v array<bigint>, pivot int, d double"), "keyed")
    parts = max(1, -(-shape["n"] // (4 * size)))

    def sorted_blocks(df, rows_each, name):
        return stored(_blocks(df.repartitionByRange(parts, "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id"), dims, rows_each, kind), name)

    data = sorted_blocks(keyed, size, "vector-blocks")
    asked = keyed.where(is_query(F.col("id")))
    queries = stored(_blocks(asked.repartitionByRange(max(1, parts // 8), "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id").coalesce(
        max(1, parts // 8)), dims, 1024, kind), "query-blocks")
    listed = data.select("block", "pivot", "near", "far", "norm", "rows").toArrow()
    blocks = spark.sparkContext.broadcast(tuple(listed.column(c).to_numpy() for c in ("block", "pivot", "near", "far", "norm", "rows")))

    def route(floors: DataFrame | None, nearest: bool) -> DataFrame:
        """(q, block, floor): pairs of blocks to compare."""
        source = queries.select("block", "ids", "v")
        if floors is not None:
            source = source.join(floors, "block")
        else:
            source = source.withColumn("floors", F.lit(b""))

        def work(batches):
            fitted, longest, dims = shared.value
            number, pivot, near, far, norm, count = blocks.value
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], np.int64)
                    x = np.frombuffer(row["v"], kind).reshape(len(ids), dims).astype(float)
                    own = (x * x).sum(1)
                    up = _raised(x, longest)
                    d = _distances(up, fitted)[:, pivot]  # queries by blocks
                    gap = np.maximum(np.maximum(d - far, near - d), 0)
                    top = np.minimum((2 * longest - gap * gap) / 2, np.sqrt(own)[:, None] * norm) * (1 + 1e-9) + 1e-3 + 1e-9 * longest
                    if nearest:  # the annuli nearest to the block's middle, until they hold k vectors
                        order = np.argsort(gap.mean(0), kind="stable")
                        last = int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1
                        chosen, floor = order[:last], np.full(len(ids), np.iinfo(np.int64).min)
                    else:
                        floor = np.frombuffer(row["floors"], np.int64)
                        chosen = np.flatnonzero((top >= floor[:, None]).any(0))
                    raw = floor.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(chosen), row["block"])), pa.array(number[chosen]), pa.array([raw] * len(chosen), pa.binary())],
                        ["q", "block", "floor"])

        return source.mapInArrow(work, "q bigint, block bigint, floor binary")

    first = stored(route(None, True), "first-pairs")
    seen = stored(_best(_search(first, data, queries, dims, k, kind), k), "first-found")
    kth = seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    spots = queries.select("block", "ids").mapInArrow(_places, "block bigint, place int, query_id bigint")
    floors = (spots.join(kth, "query_id", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "kth"))).alias("all"))
              .select("block", F.transform("all", lambda s: F.coalesce(s["kth"], F.lit(-(1 << 63)))).alias("kths")).mapInArrow(_packed, "block bigint, floors binary"))
    rest = stored(route(floors, False).join(first.select("q", "block"), ["q", "block"], "left_anti"), "other-pairs")
    more = _search(rest, data, queries, dims, k, kind)
    return _best(seen.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _places(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], ["block", "place", "query_id"])


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["block", "floors"])


ORACLE = """
WITH e AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i
      WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
