"""Exact top-k search by inner product: columnar branch and bound over integer vectors.

Components become ``floor(scale * x)``. Candidates and queries are cut into blocks of bounded size, and each pair of a
candidate block with a query block is one unit of work. A unit keeps its candidates in vertical layout, one row per
dimension, and adds up inner products one group of dimensions at a time. After each group a candidate's score can grow
by at most the product of the masses (Euclidean norms) that query and candidate have left; those that cannot reach the
k-th best exact score found so far are dropped and the survivors compacted. What is left at the end is exact, and the
units' best rows merge per query, limited before the shuffle.

Integers are added in double precision, exact below 2**53; units that could pass that bound use Python's integers.

Results: vectors that are null, empty or hold null or non-finite components, and null keys, take no part. A query meets
only candidates of its own length. Rows that repeat a key are all candidates (never of their own key) and one query, the
largest by array order. Equal scores go to the smaller key. An empty table gives no rows. A score beyond 64 bits is
given as the nearest 64-bit number.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block, on average.
CANDIDATES = 8_192
QUERIES = 2_048
#: Dimensions added at a time.
GROUP = 16

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(embedding: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocked(rows: DataFrame, place: Column, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Rows dealt to blocks of their own by place, and sent to every block of the other side.

    The place must be the same whenever a lost task runs again.
    """
    rows = rows.withColumn(own, F.pmod(place, F.lit(own_blocks)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))


def best_of_block(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, mine: np.ndarray, own: np.ndarray | None, ids: np.ndarray, k: int):
    """(ids, scores) of one query's k best in a block; ``columns`` dimension by candidate, ``rest`` masses by group."""
    alive = np.arange(len(ids)) if own is None else np.flatnonzero(ids != own)
    partial = np.zeros(len(alive))
    least = -np.inf
    for g, at in enumerate(range(0, len(columns), GROUP)):
        part = columns[at : at + GROUP]
        partial = partial + query[at : at + GROUP] @ (part if len(alive) == len(ids) else part[:, alive])
        if at + GROUP >= len(columns) or len(alive) <= k:
            continue
        # Masses are rounded, so the bound gets a little room.
        bound = partial + mine[g + 1] * rest[g + 1][alive] * (1 + 1e-9) + 1e-6
        top = alive[np.argpartition(-bound, k - 1)[:k]]
        least = max(least, float((query @ columns[:, top]).min()))
        keep = bound >= least
        alive, partial = alive[keep], partial[keep]
    if len(alive) > k:
        keep = partial >= -np.partition(-partial, k - 1)[k - 1]
        alive, partial = alive[keep], partial[keep]
    order = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[order]], partial[order]


def _unit(k: int, scale: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = (np.floor(scale * matrix(t.column("v"))) for t in (candidates, queries))
        ids, asked = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        out: list[tuple] = []
        if x.shape[1] * np.abs(x).max() * np.abs(q).max() < 2.0**52:
            columns = np.ascontiguousarray(x.T)
            groups = range(0, x.shape[1], GROUP)
            rest = np.array([np.sqrt((x[:, at:] ** 2).sum(axis=1)) for at in groups])
            mine = np.array([np.sqrt((q[:, at:] ** 2).sum(axis=1)) for at in groups])
            for i, own in enumerate(asked):
                found, score = best_of_block(q[i], columns, rest, mine[:, i], own, ids, k)
                out.append((np.full(len(found), own), found, score.astype(np.int64)))
        else:
            whole = [[int(v) for v in row] for row in x]
            for own, vector in zip(asked, q):
                ints = [int(v) for v in vector]
                scored = sorted((-sum(a * b for a, b in zip(ints, row)), int(i)) for i, row in zip(ids, whole) if i != own)[:k]
                out.append((np.full(len(scored), own), np.array([i for _, i in scored], np.int64), np.array([min(max(-s, _LEAST), _MOST) for s, _ in scored], np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], schema=schema)

    return run


def top_k(vectors: DataFrame, asked: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``asked`` holds, against all rows."""
    rows = vectors.filter(usable(F.col(embedding)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"), F.size(embedding).alias("dim"), F.coalesce(asked, F.lit(False)).alias("asked"))
    queries = rows.filter("asked").groupBy("id").agg(F.max("v").alias("v")).select("id", "v", F.size("v").alias("dim"))
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    c, q = max(1, -(-n["n"] // CANDIDATES)), max(1, -(-n["q"] // QUERIES))
    # A scan gives its rows the same places each time; repeated rows spread too.
    left = blocked(rows.drop("asked"), F.monotonically_increasing_id(), "c", c, "q", q).groupBy("dim", "c", "q")
    right = blocked(queries, F.xxhash64("id"), "q", q, "c", c).groupBy("dim", "c", "q")
    found = left.cogroup(right).applyInArrow(_unit(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir):
    """The five nearest of every fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p : p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
