"""Shared folders, folds and the byte-level view of text columns that the operators work on."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time; a cut lies at white space.
BLOCK = 1 << 17

#: Folders of local sessions that name none; the session's own settings stay as they are.
_LOCAL: dict[str, str] = {}

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15 | 1


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="llm-shared-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Jobs run inside hand Python at most so many rows at a time; the setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_columns(df: DataFrame, keep: tuple[str, ...] | None, made: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to keep (all by default) without those that are named as an output column: these give way to it."""
    return tuple(c for c in (df.columns if keep is None else keep) if c not in made)


def new_name(df: DataFrame) -> str:
    """A column name that the table does not have."""
    return max(df.columns, key=len) + "_"


def with_own_key(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The table and the column that names each of its rows: ``key`` where no row repeats or lacks it, else a new number.

    Numbered rows are written first, so that the numbers stay.
    """
    seen = df.agg(F.count("*").alias("n"), F.count(key).alias("k"), F.countDistinct(key).alias("d")).first()
    if seen["n"] == seen["k"] == seen["d"]:
        return df, key
    name = new_name(df)
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: later work starts from files, whatever is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of one run, each written to the shared folder before later work reads it, and removed when none does.

    They are written as zstd, which takes fewer bytes than the default.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._held = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self._spark, name)
        df.write.parquet(path, compression="zstd")
        table = self._spark.read.schema(df.schema).parquet(path)
        self._held.append((table, path))
        return table

    def remove(self, *tables: DataFrame) -> None:
        self._remove(lambda held: any(held is t for t in tables))

    def remove_all_but(self, *tables: DataFrame) -> None:
        self._remove(lambda held: not any(held is t for t in tables))

    def _remove(self, which: Callable[[DataFrame], bool]) -> None:
        jvm = self._spark.sparkContext._jvm
        for table, path in [x for x in self._held if which(x[0])]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self._held = [x for x in self._held if not which(x[0])]


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def sampled_ids(df: DataFrame, key: str, stratum: str, most: int) -> DataFrame:
    """Up to ``most`` keys of each stratum, by smallest hash: a sample that no order of rows changes.

    Null keys and strata take no part. With the strata's counts known, only keys below a hash that about four times
    as many pass meet in a task, however many rows a stratum has. The driver gets one count per stratum.
    """
    rows = df.select(key, stratum).filter(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    counts = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect()}
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 4 * most / n))])
    place = F.xxhash64(F.lit(17), key)
    near = rows.filter(F.pmod(place, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col(stratum)])
    order = Window.partitionBy(stratum).orderBy(F.pmod(place, F.lit(1 << 30)), key)
    return near.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most).drop("__rank")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and each row's first byte; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if starts else np.zeros(len(column) + 1, np.int64)
    offsets = offsets.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def blocks(is_space: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cuts of a column's bytes, each of about ``size``: at a row's start, else at white space within a long row.

    A word longer than a block stays whole, so a cut never parts a word.
    """
    at, end = 0, int(offsets[-1])
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            row = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            if row > at:
                stop = row
            else:
                spaces = np.flatnonzero(is_space[at + 1 : stop])
                if len(spaces):
                    stop = at + 1 + int(spaces[-1])
                else:
                    after = min(end, int(offsets[np.searchsorted(offsets, at, side="right")]))
                    later = np.flatnonzero(is_space[stop:after])
                    stop = stop + int(later[0]) if len(later) else after
        yield at, stop
        at = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, kept between blocks."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK + 1)
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            out = np.full(n, base & _MASK, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives a 64-bit hash of each span of the bytes, equal wherever the span lies."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return lambda starts, ends: mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of the spans."""
    return span_hasher(data)(starts, ends)


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a row's start ends a run."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[(offsets >= 0) & (offsets < len(inside))]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds; empty rows give 0."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=out.dtype)
    return out


def row_slices(column, size: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows with about ``size`` bytes of text together."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, len(column)) - at
        at = end


def space_table(codes: bytes) -> np.ndarray:
    """Which bytes are in ``codes``, by value."""
    out = np.zeros(256, bool)
    out[np.frombuffer(codes, np.uint8)] = True
    return out


#: The white space of the word rule `[^\x20\x09-\x0D]+`.
WHITE = space_table(b"\x09\x0a\x0b\x0c\x0d\x20")

#: Bytes with A-Z made lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def gram_blocks(column, inside: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block and length: hashes of the word-bound byte n-grams, with their rows in rising order.

    Words are runs of ``inside`` bytes; an n-gram may hold the space before and the space after its word.
    """
    data, offsets = text_bytes(column)
    held = inside[data]
    for at, stop in blocks(~held, offsets):
        row0 = int(np.searchsorted(offsets, at, side="right")) - 1
        row1 = int(np.searchsorted(offsets, stop, side="left"))
        bounds = np.clip(offsets[row0 : row1 + 1] - at, 0, stop - at)
        # Rows are set apart by two spaces: byte i of row r stands at i + 2 * (r - row0) + 1.
        rows = np.repeat(np.arange(row1 - row0), np.diff(bounds))
        place = np.arange(stop - at) + 2 * rows + 1
        line = np.full(stop - at + 2 * (row1 - row0) + 1, 32, np.uint8)
        line[place] = np.where(held[at:stop], data[at:stop], 32)
        owner = np.zeros(len(line), np.int64)
        owner[place] = rows
        running = np.concatenate([[0], np.cumsum(line == 32, dtype=np.int32)])
        code = BYTE_CODES[line]
        for n in sizes:
            m = len(line) - n + 1
            if m <= 0:
                continue
            # Spaces may stand first and last only.
            keep = np.flatnonzero(running[n - 1 : n - 1 + m] == running[1 : m + 1])
            value = np.full(len(keep), n, np.uint64)
            for j in range(n):
                value = value * np.uint64(_ODD) + code[keep + j]
            yield mixed(value), owner[keep + 1] + row0


def row_bounds(rows: np.ndarray) -> tuple[slice, np.ndarray]:
    """The slice of rows that rising row numbers span, and the bounds of each row's run."""
    first, last = int(rows[0]), int(rows[-1]) + 1
    return slice(first, last), np.searchsorted(rows, np.arange(first, last + 1))
