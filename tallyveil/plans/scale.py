"""Size checks and shared folders used by the operators."""

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.sources import versions

# A side is broadcast, or gathered for a matcher, only below both bounds.
SMALL_ROWS = 100_000
SMALL_BYTES = 16 << 20

# How intermediate tables are compressed: JSON texts and lines take a fraction of the default's bytes.
STORED_AS = "zstd"

# Bytes of a file, at most, that one task takes for heavy work on compressed rows; row groups are as large, so files can be cut.
SPLIT = 16 << 20

# Values of a partition column that a task writes side by side.
PARTS = 8

# The folder, below the shared one, of the work in hand; empty where its tables are to stay.
_WORK: ContextVar[str] = ContextVar("work", default="")


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted by partial sums; only the two numbers reach the driver."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return seen["n"], seen["b"] or 0


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether the table has at most ``max_rows`` rows and ``max_bytes`` of text."""
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast behind a size check; a larger side joins by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer partitions than cores, dealt out over the cores.

    Meant for heavy work per row on a few files; a table of many partitions stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def own_key(df: DataFrame, name: str = "__key") -> DataFrame:
    """The table with a number of its own on each row; it is written first, so that the numbers stay."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def _places(batches):
    """Adds the task's number, and each row's place among the task's rows of its key; rows come sorted by key."""
    from pyspark import TaskContext

    task, last, held = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        key = batch.column("__key")
        n = batch.num_rows
        if not n:
            continue
        differ = pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(zero_copy_only=False)
        none = key.is_null().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.flatnonzero(differ & ~(none[1:] & none[:-1])) + 1])
        place = np.arange(n) - np.repeat(first, np.diff([*first, n]))
        if last == (key[0].as_py(),):
            place[: first[1] if len(first) > 1 else n] += held
        last, held = (key[n - 1].as_py(),), int(place[-1]) + 1
        yield batch.append_column("__task", pa.array(np.full(n, task, np.int32))).append_column("__place", pa.array(place, pa.int64()))


def numbered_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within each key by ``order``, null keys too, whatever share of the rows a key has.

    Rows are sorted by ranges of key and order, so a key with very many rows lies in several tasks. Each task numbers its
    own; only keys at the edges of tasks need an offset, at most one key for each edge. The table is written in between.
    """
    # The key's text is made again after the rows have moved, so that it does not move with them.
    by = [F.col(key).cast("string"), *order]
    tagged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__key", F.col(key).cast("string"))
    schema = T.StructType([*tagged.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__place", T.LongType())])
    rows = written(tagged.mapInArrow(_places, schema), "numbered")
    group = F.struct("__key").alias("__group")
    edges = rows.groupBy("__task").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    shared = edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("__group")).groupBy("__group").count().filter("count > 1")
    held = rows.select(group, "__task").join(F.broadcast(shared), "__group", "left_semi").groupBy("__group", "__task").count()
    before = Window.partitionBy("__group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("__group", "__task", F.sum("count").over(before).alias("__before"))
    out = rows.withColumn("__group", group).join(F.broadcast(offsets), ["__group", "__task"], "left")
    return out.select(*df.columns, (F.col("__place") + F.coalesce("__before", F.lit(0))).alias(name))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Keep the rows of a condition on derived columns.

    A plain filter is pushed below the projections, which copies the expressions it refers to and
    evaluates them twice. A generator is a place the filter stays above.
    """
    flag = F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("__keep")
    return df.select("*", flag).filter("__keep").drop("__keep")


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds or replaces a column whose expression is evaluated once: filters on it, those that Spark infers from a later
    ``explode`` too, stay above the generator."""
    return df.select("*", F.explode_outer(F.array(value)).alias("__once")).withColumn(name, F.col("__once")).drop("__once")


def inline_rows(df: DataFrame, column: str, *keys) -> DataFrame:
    """One row per struct of an array column. The outer form with a filter above avoids an inferred
    size test that would evaluate the array twice."""
    names = df.schema[column].dataType.elementType.fieldNames()
    rows = df.select(*keys, F.explode_outer(column).alias("__item")).filter(F.col("__item").isNotNull())
    kept = [c for c in rows.columns if c != "__item"]
    return rows.select(*kept, *[F.col("__item")[n].alias(n) for n in names])


def _shared_root(spark: SparkSession) -> str | None:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root and root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, reachable by all executors."""
    root = _shared_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{root}{_WORK.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def intermediates_removed(spark: SparkSession):
    """Intermediate tables that are written inside go at the end, after an error too.

    They may hold texts as they were before any scrubbing. Results are lazy and read these tables: write or collect them
    before the end.
    """
    before = _WORK.set(f"{_WORK.get()}/work-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        root, work = _shared_root(spark), _WORK.get()
        _WORK.reset(before)
        if root:
            versions.remove(spark, root + work)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Jobs run inside see these settings of the session; what was set before comes back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def small_splits(spark: SparkSession):
    """Jobs run inside read files in pieces of at most ``SPLIT`` bytes: many short tasks, evenly dealt, that hold little."""
    name = "spark.sql.files.maxPartitionBytes"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return settings(spark, {name: f"{min(now, SPLIT)}b"})


def written(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """The table written once to the shared folder and read back: work after it starts from files.

    ``parts`` names columns of few values, which get folders of their own, so that a filter on them reads no others. A task
    keeps a file open for each of up to ``PARTS`` values; only beyond that it sorts its rows by them.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*(parts or [])).option("parquet.block.size", SPLIT)
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(PARTS)} if parts else {}):
        writer.parquet(path, compression=STORED_AS)
    return df.sparkSession.read.schema(df.schema).parquet(path)
