"""Near-duplicate documents by an LSH forest over MinHash signatures, every link confirmed on full shingle sets.

1. A document's set holds its distinct word shingles (64-bit hashes of whole texts). Equal sets form a class, stood for
   by its smallest id; classes are found by the sets' digests, pre-aggregated.
2. The forest: ``ORDERS`` sorted orders of the signatures, each starting at another coordinate, range partitioned, so a
   frequent value spreads over partitions. Neighbours in an order share the longest prefixes and are candidates.
   A region, the rows with a common prefix, also proposes its hub (the row whose signature agrees most with the
   region's) to its rows; rows whose signatures are far from the hub's go one coordinate deeper, up to ``PREFIX``.
   A pair is proposed only if its signatures agree as a pair at the threshold does, but for a 5.5 sigma margin.
3. Confirmation reads the texts of candidates only: first each row with its best hub, then all pairs that the first
   links have not already joined. No pair within a group is needed twice, so copies never expand into all pairs.
4. Components of the links by alternating star contraction, written to the shared folder in each round.
5. What the forest left apart is joined exactly: with shingles in one order, rare ones first, two sets as similar as
   asked share one of their first shingles, at places that leave enough shingles behind (prefix and positional filter).
   In the smaller of two such sets that shingle stands further ahead still, and their sizes lie close: a posting meets
   only those of a fitting class of sizes, and a shingle that stands too far back in all its sets meets nothing, however
   many texts share it. Sets of different components that meet are confirmed on their texts, and the links between
   components contracted.

The forest only saves work: it joins large groups, so that step 5 never expands a group into pairs of its own. No link is
missed, whatever the forest proposes; the tests compare with brute force. Shingle counts in ``1 << COUNTED`` buckets
decide the order, which changes the number of candidates, never the links.

Shingles of one slice of texts at a time are in memory, signatures of one partition's batch, and of confirmation one batch
of pairs. Nothing but counts
reaches the driver, of shingles those of the buckets.

Results: one row per input row. Null keys: the row keeps a null component and is linked with nothing. Null or empty
texts, and texts without words: 0 shingles, own component. Rows that repeat a key are one document; if their texts
differ, its links are confirmed on the last text in byte order. An empty table gives no rows.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import LOWER, WHITE, Steps, blocks, mixed, row_slices, small_batches, span_hashes, text_bytes, word_spans

#: Coordinates of a signature; an order starts at every fourth and is PREFIX coordinates deep.
WIDTH = 64
ORDERS = 16
PREFIX = 8
#: Neighbours in an order that a row is compared with; farther rows of a region are reached through its hub.
AHEAD = 4
#: Sigmas by which a candidate pair's agreement may fall short.
SIGMAS = 5.5
#: Rows of an order whose regions are worked out at once.
BATCH = 10_000
#: Bytes of text whose words and shingles a task holds at once; a longer text stands alone.
TEXTS = 1 << 20
#: Bits of a shingle that choose the bucket of its count; a table's buckets travel in CHUNKS parts.
COUNTED = 22
CHUNKS = 64
#: What postings of two sets must have in common to meet: a shingle, the smaller set's class of sizes, and whether that set
#: is of the shingle's main part.
MEET = ["shingle", "sizes", "in_main"]

_SEEDS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTORS = mixed(_SEEDS) | np.uint64(1)


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, A-Z lower-cased, and each row's bounds among them."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    inside = ~WHITE[data]
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in blocks(~inside, offsets):
        starts, ends = word_spans(inside[at:stop], offsets[(offsets >= at) & (offsets < stop)] - at)
        found.append(span_hashes(data[at:stop], starts, ends))
        rows.append(np.searchsorted(offsets, starts + at, side="right") - 1)
    return np.concatenate(found), np.searchsorted(np.concatenate(rows), np.arange(len(column) + 1))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of one text's words; fewer words than ``size`` are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    span = min(size, len(words))
    value = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - span + 1 + j]
    return np.unique(mixed(value))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest hash for each coordinate; worked on in parts, so a long text stays small."""
    least = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        part = shingles[at : at + (1 << 12), None]
        least = np.minimum(least, ((part ^ _SEEDS) * _FACTORS).min(axis=0))
    return (mixed(least) >> np.uint64(48)).astype(">u2")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTED)).astype(np.int64)


def _sliced(batches):
    """The rows in slices of about ``TEXTS`` bytes of text."""
    for batch in batches:
        for at, n in row_slices(batch.column("text"), TEXTS):
            yield batch.slice(at, n)


def _sketch(size: int):
    """A row for each text; at the end rows of n < 0 with the task's shingle counts: places in a chunk, and their counts."""
    names = ["key", "n", "digest", "mark", "low"]

    def run(batches):
        counts = np.zeros((CHUNKS, (1 << COUNTED) // CHUNKS), np.uint32)
        for batch in _sliced(batches):
            words, bounds = word_hashes(batch.column("text"))
            n, digests, marks, lows = [], [], [], []
            for i in range(batch.num_rows):
                held = shingle_set(words[bounds[i] : bounds[i + 1]], size)
                n.append(len(held))
                if len(held):
                    np.add.at(counts.reshape(-1), _bucket(held), np.uint32(1))
                    mark = signature(held)
                    digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                    marks.append(mark.tobytes())
                    lows.append(mark.astype(np.uint8).tobytes())
                else:
                    digests.append(None), marks.append(None), lows.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary()), pa.array(lows, pa.binary())], names=names)
        for i, chunk in enumerate(counts):
            at = np.flatnonzero(chunk)
            if len(at):
                row = [None], [-1 - i], [None], [at.astype("<u4").tobytes()], [chunk[at].astype("<u4").tobytes()]
                kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

    return run


def _summed(batches):
    """The tasks' counts added up, a row for each chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, at, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "mark", "low"))):
            held = sums.setdefault(n, np.zeros((1 << COUNTED) // CHUNKS, np.int64))
            held[np.frombuffer(at, "<u4")] += np.frombuffer(counts, "<u4")
    for n, held in sums.items():
        counts = np.minimum(held, np.iinfo(np.uint32).max).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([counts], pa.binary())], names=["n", "counts"])


def prefix_length(n: int, percent: int) -> int:
    """First shingles of a set of n that a set as similar as asked must share one of."""
    return n + percent * n // -100 + 1


def _prefixes(size: int, percent: int, shared):
    """Each set's first shingles, rare ones first."""

    def run(batches):
        counts = shared.value
        for batch in _sliced(batches):
            words, bounds = word_hashes(batch.column("text"))
            n, digests, firsts = [], [], []
            for i in range(batch.num_rows):
                held = shingle_set(words[bounds[i] : bounds[i + 1]], size)
                n.append(len(held))
                digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                order = np.lexsort((held, counts[_bucket(held)]))
                firsts.append(held[order[: prefix_length(len(held), percent) if len(held) else 0]].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(firsts, pa.binary())], names=["id", "digest", "n", "first"])

    return run


def _postings(batches):
    """A row for each of a set's first shingles, with its place."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            piece = batch.slice(at, 1000)
            firsts = [np.frombuffer(x, "<u8") for x in piece.column("first").to_pylist()]
            length = np.array([len(x) for x in firsts])
            rows = pa.array(np.repeat(np.arange(len(firsts)), length))
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            columns = [pa.array(np.concatenate(firsts).astype(np.uint64).view(np.int64)), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*columns, *(piece.column(c).take(rows) for c in ("id", "n", "part"))], names=["shingle", "place", "id", "n", "part"])


def least_agreement(threshold: float) -> int:
    """Equal coordinates below which a pair at the threshold practically never falls."""
    return max(1, int(np.floor(WIDTH * threshold - SIGMAS * np.sqrt(WIDTH * threshold * (1 - threshold)))))


def _hub_pairs(prefix: np.ndarray, low: np.ndarray, ids: np.ndarray, least: int):
    """(hub, row, agreement) of the regions of sorted rows, deeper where a region's hub does not explain a row."""
    active = np.arange(len(ids))
    for depth in range(1, PREFIX + 1):
        if not len(active):
            return
        part = prefix[active, :depth]
        new = np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])
        region = np.cumsum(new) - 1
        count = np.bincount(region)
        big = count[region] >= 3
        active, region = active[big], region[big]
        if not len(active):
            return
        region = np.unique(region, return_inverse=True)[1]
        regions = int(region[-1]) + 1
        popular = np.zeros(len(active), np.int64)
        for c in range(WIDTH):
            cell = region * 256 + low[active, c]
            popular += np.bincount(cell, minlength=regions * 256)[cell]
        order = np.lexsort((ids[active], -popular, region))
        hub = active[order[np.searchsorted(region[order], np.arange(regions))]][region]
        agree = (low[hub] == low[active]).sum(axis=1)
        good = (agree >= least) & (hub != active)
        yield ids[hub[good]], ids[active[good]], agree[good]
        active = active[~good & (hub != active)]


def _candidates(least: int):
    """Pairs (a < b) of a sorted order's rows: neighbours, and rows with their regions' hubs (kind 1)."""

    def run(batches):
        tail = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                n = piece.num_rows
                ids = piece.column("id").to_numpy()
                order = piece.column("order").to_numpy().astype(np.uint16)
                prefix = np.frombuffer(b"".join(piece.column("prefix").to_pylist()), ">u2").reshape(n, PREFIX).astype(np.uint16)
                prefix = np.concatenate([order[:, None], prefix], axis=1)
                prefix = np.concatenate([prefix[:, :1].astype(np.uint32) << 16 | prefix[:, 1:2], prefix[:, 2:]], axis=1)
                low = np.frombuffer(b"".join(piece.column("low").to_pylist()), np.uint8).reshape(n, WIDTH)
                out = []
                for a, b, agree in _hub_pairs(prefix, low, ids, least):
                    out.append((a, b, agree, np.ones(len(a), np.int32)))
                if tail is not None:
                    ids, prefix, low = (np.concatenate([x, y]) for x, y in zip(tail, (ids, prefix, low)))
                for ahead in range(1, AHEAD + 1):
                    if ahead < len(ids):
                        near = np.flatnonzero(prefix[ahead:, 0] == prefix[:-ahead, 0])
                        agree = (low[near] == low[near + ahead]).sum(axis=1)
                        good = near[agree >= least]
                        out.append((ids[good], ids[good + ahead], agree[agree >= least], np.zeros(len(good), np.int32)))
                tail = ids[-AHEAD:], prefix[-AHEAD:], low[-AHEAD:]
                a, b, agree, kind = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4))
                first, second = np.minimum(a, b), np.maximum(a, b)
                keep = first != second
                # A batch's pairs meet in several orders and regions; each goes out once.
                key = np.stack([first[keep], second[keep]])
                if key.size:
                    spot = np.lexsort((-kind[keep], key[1], key[0]))
                    key, agree, kind, hub = key[:, spot], agree[keep][spot], kind[keep][spot], a[keep][spot]
                    one = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[0][one]), pa.array(key[1][one]), pa.array(agree[one].astype(np.int32)), pa.array(hub[one].astype(np.int64), mask=kind[one] == 0)], names=["a", "b", "agree", "hub"])

    return run


def _confirm(size: int, percent: int):
    """Pairs whose full sets overlap as asked; each text of a batch is shingled once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = {}
                for name, text in (("a", "text_a"), ("b", "text_b")):
                    ids = piece.column(name).to_pylist()
                    first = {k: i for i, k in reversed(list(enumerate(ids))) if k not in sets}
                    words, bounds = word_hashes(piece.column(text).take(pa.array(list(first.values()), pa.int64())))
                    sets |= {k: shingle_set(words[bounds[i] : bounds[i + 1]], size) for i, k in enumerate(first)}
                keep = []
                for a, b in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist()):
                    x, y = sets[a], sets[b]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The confirmed pairs. Both joins are against one row per id, so a hub's many pairs can be split."""
    left = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long")


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(id, component) of every linked id, component its smallest reachable id.

    Large-star and small-star steps in turn move all of a node's neighbours to its smallest one until nothing changes.
    """

    def star(edges, large):
        u, v = (("a", "b"), ("b", "a"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(edges):
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    steps = steps or Steps(links.sparkSession)
    edges = steps.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        before, edges = edges, steps.stored(star(star(edges, True), False), "edges")
        steps.remove(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    member = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return member.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _shared_counts(sketch: DataFrame):
    """The bucket counts of all shingles, as a broadcast of fixed size."""
    table = np.zeros((CHUNKS, (1 << COUNTED) // CHUNKS), np.uint32)
    rows = sketch.filter("n < 0").select("n", "mark", "low").repartition("n").mapInArrow(_summed, "n long, counts binary")
    for r in rows.collect():  # CHUNKS rows at most
        table[-1 - r["n"]] = np.frombuffer(r["counts"], "<u4")
    return sketch.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _size_class(n: str, percent: int) -> str:
    """The class of a set's size: sizes as close as the share asks lie in one class or in two that follow each other."""
    return f"{n}" if percent == 100 else f"cast(floor(ln({n}) / {math.log(100 / percent)}) AS long)"


def _sides(flat: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Postings as those of a pair's smaller set and of its larger one, which meet by ``MEET``."""
    small = flat.filter("ahead").select("shingle", F.expr(_size_class("n", percent)).alias("sizes"), "in_main", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "part", "place")])
    # The larger set of a pair: sizes of partners that its place leaves possible, down to the share asked.
    most = f"least(n, ({100 + percent} * (n - place) - {percent} * n) div {percent})"
    fewest = f"({percent} * n + 99) div 100"
    large = flat.withColumn("most", F.expr(most)).withColumn("fewest", F.expr(fewest)).filter("fewest <= most")
    sizes = F.explode(F.expr(f"sequence({_size_class('fewest', percent)}, {_size_class('most', percent)})"))
    large = large.select("shingle", sizes.alias("sizes"), "in_main", "fewest", "most", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "part", "place")])
    mains = F.when(F.col("in_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    large = large.withColumn("in_main", F.explode(mains))
    return small, large


def _pairs_apart(steps: Steps, rows: DataFrame, classes: DataFrame, parts: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """(a, b, part_a, part_b): all pairs of classes in different parts that may be as similar as asked.

    ``parts`` has (id, component) of the classes that are joined to others already.
    """
    texts = rows.filter("key IS NOT NULL").select(F.col("key").alias("id"), "text")
    firsts = texts.mapInArrow(_prefixes(size, percent, shared), "id long, digest binary, n long, first binary").filter("n > 0")
    firsts = firsts.join(classes.select("id", "digest"), ["id", "digest"]).groupBy("id", "digest").agg(F.min("n").alias("n"), F.min("first").alias("first"))
    firsts = firsts.join(parts, "id", "left").select("id", "n", "first", F.coalesce("component", "id").alias("part"))
    with small_batches(rows.sparkSession):
        firsts = steps.stored(firsts, "firsts")
    flat = firsts.mapInArrow(_postings, "shingle long, place long, id long, n long, part long")
    # So far ahead the shingle stands in the smaller set of a pair, or in both of equal size.
    flat = flat.withColumn("ahead", F.expr(f"{100 + percent} * (n - place) >= {2 * percent} * n"))
    met = flat.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.max("ahead").alias("ahead"))
    flat = steps.stored(flat.join(met.filter("ahead AND least < most").select("shingle"), "shingle", "left_semi"), "postings")
    steps.remove(firsts)
    # Of a shingle's parts the largest is never met with itself, so a group's common shingles stay one row each.
    main = flat.groupBy("shingle", "part").count().groupBy("shingle").agg(F.max(F.struct("count", "part")).alias("top"))
    flat = flat.join(main.select("shingle", F.col("top.part").alias("main")), "shingle").withColumn("in_main", F.col("part") == F.col("main"))
    small, large = _sides(flat, percent)
    enough = f"n_a BETWEEN fewest AND most AND {100 + percent} * (n_a - place_a) >= {percent} * (n_a + n_b)"
    met = small.join(large, MEET).filter("part_a <> part_b").filter(enough)
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    return met.select(pick("id", "a", "b").alias("a"), pick("id", "b", "a").alias("b"), pick("part", "a", "b").alias("part_a"), pick("part", "b", "a").alias("part_b")).distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; see the module. ``percent``: least similarity in hundredths."""
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    steps = Steps(documents.sparkSession)
    with small_batches(documents.sparkSession):
        sketched = steps.stored(rows.mapInArrow(_sketch(shingle), "key long, n long, digest binary, mark binary, low binary"), "sketch")
    shared = _shared_counts(sketched)
    sketch = sketched.filter("n >= 0")
    full = sketch.filter(F.col("digest").isNotNull() & F.col("key").isNotNull())
    classes = steps.stored(full.groupBy("digest").agg(F.min("key").alias("id"), F.min("mark").alias("mark"), F.min("low").alias("low")), "classes")
    least = least_agreement(percent / 100)
    step = WIDTH // ORDERS
    orders = classes.select("id", "mark", "low", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("order"))
    orders = orders.select("id", "low", "order", F.substring(F.concat("mark", "mark"), 1, 4 * WIDTH).alias("ring"))
    orders = orders.select("id", "low", "order", F.expr(f"substring(ring, 1 + {2 * step} * order, {2 * PREFIX})").alias("prefix"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = orders.repartitionByRange(parts, "order", "prefix", "id").sortWithinPartitions("order", "prefix", "id")
    pairs = sorted_.mapInArrow(_candidates(least), "a long, b long, agree int, hub long")
    pairs = pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"), F.max("hub").alias("hub"))
    pairs = steps.stored(pairs, "candidates")
    keys = full.agg(F.count("key").alias("n"), F.countDistinct("key").alias("d")).first()

    def texts_of(pairs):
        involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        texts = rows.select(F.col("key").alias("id"), "text").join(involved.hint("shuffle_hash"), "id", "left_semi")
        return steps.stored(texts if keys["n"] == keys["d"] else texts.groupBy("id").agg(F.max("text").alias("text")), "texts")

    texts = texts_of(pairs)
    # Each row with the hub it agrees with most; then what those links leave apart.
    spoke = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    best = pairs.filter("hub IS NOT NULL").withColumn("spoke", spoke).groupBy("spoke").agg(F.max(F.struct("agree", (-F.col("hub")).alias("hub"))).alias("top"))
    first = best.select(F.least("spoke", -F.col("top.hub")).alias("a"), F.greatest("spoke", -F.col("top.hub")).alias("b")).distinct()
    with small_batches(documents.sparkSession):
        joined = steps.stored(_links(first, texts, shingle, percent), "links")
    label = steps.stored(components(joined, steps), "labels")
    of = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"{side}_in"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.withColumn("x", F.coalesce("a_in", "a")).withColumn("y", F.coalesce("b_in", "b")).filter("x <> y")
    with small_batches(documents.sparkSession):
        more = steps.stored(_links(rest, texts, shingle, percent), "links")
    whole = steps.stored(components(joined.unionByName(more), steps), "components")
    steps.remove_all_but(sketched, classes, whole)
    apart = steps.stored(_pairs_apart(steps, rows, classes, whole, shared, shingle, percent), "apart")
    if not apart.isEmpty():
        with small_batches(documents.sparkSession):
            found = steps.stored(_links(apart, texts_of(apart), shingle, percent), "links")
        bridges = found.join(apart, ["a", "b"]).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        moved = steps.stored(components(bridges, steps), "moved").select(F.col("id").alias("part"), F.col("component").alias("target"))
        ids = classes.select("id").distinct().join(whole, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
        whole = steps.stored(ids.join(moved, "part", "left").select("id", F.coalesce("target", "part").alias("component")), "components")
    steps.remove_all_but(sketched, classes, whole)
    named = sketch.select("key", "n", "digest").join(classes.select("digest", "id"), "digest", "left")
    named = named.join(whole, "id", "left")
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id", "key").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8(spark, sf_dir):
    """Classes of documents whose three-word shingle sets overlap by 85 hundredths or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.q FROM reach r JOIN links l ON l.p = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
