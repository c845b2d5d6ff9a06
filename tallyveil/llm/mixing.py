"""Mixing sources to target weights by balanced sampling with the cube method.

Sources in code point order, null last, get weights in turn. A source's target is its weight's share of all words, but
at most ``most`` times its own words; what lies above is shared again by weight among the others until none is above.
A document is taken ``floor(target / source words)`` times, and once more with the fraction left as its inclusion
probability.

Who gets the extra copy is drawn by the cube method. A flight moves three open probabilities at a time along the
null space of the two constraints (words and documents), so both totals stay exactly what they were until at most two
probabilities of a block are open. Blocks of a source are flown apart; what they leave open is flown again in merged
blocks until one block per source is left. Its last two documents and a dozen kept out of the flight are the landing
problem: of all choices the one that misses the words least, then the documents; a gap that a huge document leaves is
closed by changing decided documents, the nearest to it first. Draws are seeded by source, block and level, and a block's rows
are sorted, so reruns agree.

A block holds ``BLOCK`` rows on average, whatever the size of its source. Only totals reach the driver.

Results: null texts have size 0; documents of size 0 are never taken more than their full copies say and count as 0
words. Without any words every target is 0. Repeated rows are drawn each for itself. An empty table gives no rows.
"""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import stored

#: Documents of a block on average; each block leaves two open for the next level.
BLOCK = 2_048
#: Blocks that one block of the next level takes in.
FAN_IN = 512
#: Documents of each source that the landing problem takes in beside the two that a flight leaves open.
LANDING = 12
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7

_SCHEMA = "key long, source string, size long, source_size long, target double, full long, p double, block long, blocks long"


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size) of each row, size its number of words."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return documents.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), size.alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order from 0, null last; no task sorts all of them."""
    rows = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    first, before = {}, 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a row per partition
        first[r["part"]] = before
        before += r["count"]
    if not first:
        return rows.withColumn("rank", F.col("at")).drop("at")
    offset = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[part]
    return rows.withColumn("rank", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) of every source; ``sizes`` has source and size by row."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(ranked(totals).withColumn("weight", weight.cast("double")).drop("rank"), "sources")
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, 0
    while True:
        above = F.col("weight") * level > most * F.col("source_size") if level >= 0 else F.lit(False)
        row = rows.agg(F.count(F.when(above, 1)).alias("capped"), F.sum(F.when(above, most * F.col("source_size"))).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if level >= 0 and row["capped"] == capped or not row["free"]:
            break
        capped, level = row["capped"], (whole - (row["taken"] or 0)) / row["free"]
    cap = most * F.col("source_size").cast("double")
    return rows.withColumn("target", F.least(F.col("weight") * max(level, 0.0), cap)).drop("weight")


def _step(size: list[float], p: list[float], i: int, j: int, k: int, rng: random.Random) -> None:
    """Move three probabilities along the null space of (sizes, ones) until one is 0 or 1."""
    a, b, c = size[i], size[j], size[k]
    move = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
    up = down = float("inf")
    for at, u in zip((i, j, k), move):
        if u > 0:
            up, down = min(up, (1 - p[at]) / u), min(down, p[at] / u)
        elif u < 0:
            up, down = min(up, p[at] / -u), min(down, (1 - p[at]) / -u)
    by = up if rng.random() * (up + down) < down else -down
    for at, u in zip((i, j, k), move):
        x = p[at] + by * u
        p[at] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def fly(size: list[float], p: list[float], rng: random.Random, land: bool) -> list[float]:
    """Probabilities after the flight: 0 or 1 but for two at most, and for none if ``land``.

    A landing also keeps ``LANDING`` documents of all sizes out of the flight and tries every choice of these and of
    what the flight leaves open.
    """
    drawn, p = list(p), list(p)
    order = all_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    kept: list[int] = []
    if land:
        by_size = sorted(order, key=lambda i: size[i])
        kept = [by_size[j] for j in sorted({int(x) for x in np.linspace(0, len(by_size) - 1, min(LANDING, len(by_size)))})]
        held = set(kept)
        order = [i for i in order if i not in held]
    order = list(order)
    rng.shuffle(order)
    open_: list[int] = []
    for at in order:
        open_.append(at)
        while len(open_) == 3:
            _step(size, p, *open_, rng)
            open_ = [i for i in open_ if 0 < p[i] < 1]
    if land and (last := open_ + kept):
        choice = np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1
        gap = choice - np.array([p[i] for i in last])
        words, rows = np.abs(gap @ np.array([size[i] for i in last])), np.abs(gap.sum(axis=1))
        for x, i in zip(choice[np.lexsort((rows, np.round(words, 6)))[0]], last):
            p[i] = float(x)
        # A document as large as its source's target may leave a gap that only decided ones can close.
        gap = words.min() if len(words) else 0.0
        signed = sum((p[i] - q) * s for i, (q, s) in enumerate(zip(drawn, size)))
        while gap > 1:
            able = [i for i in all_ if (p[i] == 1) == (signed > 0)]
            best = min(able, key=lambda i: (abs(abs(signed) - size[i]), i), default=None)
            if best is None or abs(abs(signed) - size[best]) >= abs(signed):
                break
            signed += size[best] if p[best] == 0 else -size[best]
            p[best], gap = 1 - p[best], abs(signed)
    return p


def _fly_block(level: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("size", "ascending")])
        source, block, blocks = (table.column(c)[0].as_py() for c in ("source", "block", "blocks"))
        rng = random.Random(zlib.crc32(repr((seed, level, source, block)).encode()))
        p = fly([float(x) for x in table.column("size").to_pylist()], table.column("p").to_pylist(), rng, blocks == 1)
        return table.set_column(table.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(key, source, size, source_size, target, copies) of every row: how often the mix takes it."""
    sizes = stored(sized(documents, key, text, source).withColumn("place", F.monotonically_increasing_id()), "sizes")
    # Rows that nothing tells apart are dealt by their place where a block could not hold them: fewer than rows / block.
    alike = sizes.groupBy("key", "size").count().filter(F.col("count") > BLOCK // 4).select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.lit(True).alias("alike"))
    sizes = sizes.join(F.broadcast(alike), F.col("key").eqNullSafe(F.col("__key")) & (F.col("size") == F.col("__size")), "left")
    sizes = sizes.withColumn("place", F.when(F.col("alike"), F.col("place")).otherwise(F.lit(0))).drop("__key", "__size", "alike")
    goal = stored(targets(sizes, weights, most), "targets")
    rows = sizes.join(goal.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = F.least(F.floor(ratio + F.lit(1e-12)), F.lit(most)).cast("long")
    part = F.greatest(ratio - full, F.lit(0.0))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    rows = rows.withColumn("full", full).withColumn("p", F.when(F.col("size") > 0, part).otherwise(F.lit(0.0)))
    rows = rows.withColumn("blocks", F.greatest(blocks, F.lit(1))).withColumn("block", F.expr("pmod(xxhash64(key, size, place), blocks)"))
    rows = rows.select("key", "source", "size", "source_size", "target", "full", "p", "block", "blocks")
    open_, done, level = rows.filter("p > 0 AND p < 1"), [rows.filter("p <= 0 OR p >= 1")], 0
    while True:
        flown = stored(open_.groupBy("source", "block").applyInArrow(_fly_block(level, seed), _SCHEMA), f"flight-{level}")
        done.append(flown.filter("p <= 0 OR p >= 1"))
        rest = flown.filter("p > 0 AND p < 1")
        if rest.isEmpty():
            break
        fewer = F.ceil(F.col("blocks") / F.lit(FAN_IN)).cast("long")
        open_, level = rest.withColumn("blocks", fewer).withColumn("block", F.expr("block % blocks")), level + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("full") + F.col("p").cast("long")).alias("copies"))


def op7(spark, sf_dir):
    """The words that a mix of all sources takes of every document."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
