"""Spelling variants of words, by a trie over letter-group counts.

Words are counted per slice of texts and then by Spark. Each word has a vector: its length, then how often each of
``GROUPS`` letter groups occurs in it. The groups are dealt from the letters' counts, so that they hold about equal
shares; what reaches the driver for this is one count per letter. One edit moves a vector by at most one surplus and one
deficit: an inserted letter is a surplus, a replaced one a surplus and a deficit (or nothing, within a group).

The trie's upper levels (the length and the first counts) deal the words to cells, with Spark: a word lies in one cell
and asks every cell that the budget reaches. Each pair is met from one side only: the shorter word asks for the longer,
and between words of one length the first difference must be a surplus. The number of upper levels grows with the
vocabulary; a cell of over ``CELL`` words is split into blocks by hash, and its askers go to every block. In a task, the
words of a block form the rest of the trie; a depth-first search carries all asking words of a batch and drops those
whose budget is spent. Leaves hold up to ``LEAF`` words, each compared with what arrives there, letter by letter.

A word's form is its near word of largest count (ties: smallest in code-point order), if that count is ``RATIO`` times
its own. Counts rise by that factor along forms, so a few doubling steps, known from the largest count, find the roots.

Results: null texts have no words; a null document key counts as empty in what ``spoil`` hashes; repeated rows count each
time; other columns do not matter; an empty table gives no rows. Runs of any length are words. Letters are a-z, A-Z and
the code points U+00C0 to U+00FF, each one byte of Latin-1; only A-Z are made lower case.
"""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import row_slices, stored

#: A word has at least so many code points, and occurrences.
SHORTEST = 7
FEWEST = 2
#: How many times more frequent than a word its form is.
RATIO = 10
GROUPS = 12
#: Words, and bytes of words, that a task searches at once.
CELL = 16_384
CELL_BYTES = 32 << 20
LEAF = 4
#: Bytes of text whose words a task counts at once, and bytes of words compared at once.
SLICE = 4 << 20
COMPARED = 8 << 20

#: What a surplus of -1, 0 or 1 makes of a state; -1: out of budget. States of equal lengths: 0 nothing spent, 1 a
#: surplus, 2 both. States of a word one letter shorter: 3 nothing spent, 4 the surplus.
_NEXT = np.array([[-1, 0, 1], [2, 1, -1], [-1, 2, -1], [-1, 3, 4], [-1, 4, -1]], np.int8)
_DONE = np.array([True, False, True, False, True])


def spoil(key: str, run: str, every: int) -> str:
    """The run, or the run less one letter where ``every`` divides the crc32 of ``key:run``."""
    return _spoiled(zlib.crc32(f"{key}:".encode()), run, every)


def _spoiled(start: int, run: str, every: int) -> str:
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, key: str | None = None, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters and ``fewest`` occurrences. With ``key``, runs pass ``spoil`` first."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def count(batches):
        for batch in batches:
            for at, n in row_slices(batch.column("__text"), SLICE):
                part = batch.slice(at, n)
                found: Counter = Counter()
                for own, low in zip(part.column("__key").to_pylist(), pc.ascii_lower(part.column("__text")).to_pylist()):
                    if not low:
                        continue
                    if own is None:
                        found.update(runs.findall(low))
                        continue
                    start = zlib.crc32(f"{own}:".encode())
                    for run, times in Counter(runs.findall(low)).items():
                        found[_spoiled(start, run, every)] += times
                yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    own = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit(None).cast("string")
    rows = documents.select(own.alias("__key"), F.col(text).alias("__text")).mapInArrow(count, "word string, n long")
    long_enough = rows.filter(F.char_length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def _latin(column) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a column's words as Latin-1 codes in one array, and the words' bounds."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return np.frombuffer(b"".join(words), np.uint8), bounds


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each Latin-1 code. Frequent letters come first, each to the lightest group; group 0 is the heaviest."""

    def tally(batches):
        for batch in batches:
            seen = np.bincount(_latin(batch.column("word"))[0], minlength=256)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"letter": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})

    counts = words.select("word").mapInArrow(tally, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    weight, own = [0] * groups, np.zeros(256, np.int64)
    for letter, n in sorted(((r["letter"], r["n"]) for r in counts), key=lambda x: (-x[1], x[0])):
        lightest = weight.index(min(weight))
        own[letter] = lightest
        weight[lightest] += n
    heaviest = sorted(range(groups), key=lambda g: (-weight[g], g))
    return np.argsort(heaviest)[own]


def vectors(letters: np.ndarray, bounds: np.ndarray, own: np.ndarray, groups: int) -> np.ndarray:
    """Word by group: how many of its letters are in the group."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(rows * groups + own[letters], minlength=(len(bounds) - 1) * groups).reshape(-1, groups).astype(np.int32)


def routes(levels: int) -> list[tuple[np.ndarray, int]]:
    """What can be spent on the upper levels (the length, then counts), with the state after them."""
    out = [(np.zeros(levels + 1, np.int32), 0), (np.eye(1, levels + 1, dtype=np.int32)[0], 3)]
    for i in range(1, levels + 1):
        more = np.zeros(levels + 1, np.int32)
        more[i] = 1
        out.append((more, 1))
        longer = more.copy()
        longer[0] = 1
        out.append((longer, 4))
        for j in range(i + 1, levels + 1):
            both = more.copy()
            both[j] = -1
            out.append((both, 2))
    return out


def _binary_rows(values: np.ndarray) -> pa.Array:
    """Each row of an integer array as a binary value."""
    data = np.ascontiguousarray(values, ">i4")
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (4 * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: whether exactly one letter differs."""
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: whether b is a with one letter inserted."""
    head = np.concatenate([a == b[:, :-1], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    tail = np.concatenate([(a == b[:, 1:])[:, ::-1], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    return head + tail >= a.shape[1]


class Cell:
    """The words of a block, all of one length, as a trie over the lower levels."""

    def __init__(self, words: pa.Array, own: np.ndarray, groups: int, levels: int):
        letters, bounds = _latin(words)
        made = vectors(letters, bounds, own, groups)
        order = np.lexsort(made[:, ::-1].T)
        self.own, self.groups, self.levels = own, groups, levels
        self.counts, self.place = made[order], order
        self.letters = letters.reshape(len(order), -1)[order]

    def near(self, words: pa.Array, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asking word, word of the block) that are one edit apart."""
        letters, bounds = _latin(words)
        counts = vectors(letters, bounds, self.own, self.groups)
        equal = state < 3
        asks, holds = [], []
        for part in (np.flatnonzero(equal), np.flatnonzero(~equal)):
            if not len(part):
                continue
            size = self.letters.shape[1] - (0 if equal[part[0]] else 1)
            matrix = letters[(bounds[part][:, None] + np.arange(size)).ravel()].reshape(len(part), size)
            for ask, hold in self._leaves(counts[part], state[part]):
                a, b = matrix[ask], self.letters[hold]
                same = equal[part[0]]
                good = _one_replaced(a, b) if same else _one_inserted(a, b)
                if same:
                    # Each pair from one side: the first difference is a surplus; of equal vectors the smaller word asks.
                    line = np.arange(len(a))
                    surplus = self.counts[hold] - counts[part][ask]
                    sign = surplus[line, (surplus != 0).argmax(axis=1)]
                    at = (a != b).argmax(axis=1)
                    good &= (sign > 0) | ((sign == 0) & (a[line, at] < b[line, at]))
                asks.append(part[ask[good]])
                holds.append(self.place[hold[good]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *asks]), np.concatenate([none, *holds])

    def _leaves(self, counts: np.ndarray, state: np.ndarray):
        """Candidates by depth-first search, in parts of bounded size."""
        most = max(1, COMPARED // max(1, self.letters.shape[1]))
        stack = [(self.levels, 0, len(self.counts), np.arange(len(counts)), state)]
        while stack:
            level, low, high, alive, spent = stack.pop()
            if level == self.groups:
                alive = alive[_DONE[spent]]
            if level == self.groups or high - low <= LEAF:
                step = max(1, most // (high - low))
                for at in range(0, len(alive), step):
                    some = alive[at : at + step]
                    for first in range(low, high, most):
                        held = np.arange(first, min(high, first + most))
                        yield np.repeat(some, len(held)), np.tile(held, len(some))
                continue
            column = self.counts[low:high, level]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
            asked = counts[alive, level]
            for a, b in zip(cuts[:-1], cuts[1:]):
                surplus = column[a] - asked
                close = np.flatnonzero(np.abs(surplus) <= 1)
                after = _NEXT[spent[close], surplus[close] + 1]
                go = close[after >= 0]
                if len(go):
                    stack.append((level + 1, low + int(a), low + int(b), alive[go], after[after >= 0]))


def upper_levels(n_words: int, groups: int = GROUPS) -> int:
    """How many counts deal the words to cells: a level divides a cell about by three, a length by eight."""
    return min(groups, max(2, math.ceil(math.log(max(1.0, n_words / (4 * CELL)), 3))))


def near_pairs(words: DataFrame, groups: int = GROUPS, levels: int | None = None, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words that are one edit apart.

    ``words`` (word, n): distinct, of letters only; it is read several times, so it should be a written table.
    """
    own = letter_groups(words, groups)
    levels = upper_levels(words.count(), groups) if levels is None else levels
    ways = routes(levels)

    def route(batches):
        for batch in batches:
            for at, n in row_slices(batch.column("word"), SLICE):
                part = batch.slice(at, n)
                letters, bounds = _latin(part.column("word"))
                upper = np.concatenate([np.diff(bounds)[:, None], vectors(letters, bounds, own, groups)[:, :levels]], axis=1)
                yield placed(part, upper, np.arange(n), -1)
                for spend, state in ways:
                    target = upper + spend
                    fits = np.flatnonzero((target >= 0).all(axis=1))
                    yield placed(part, target[fits], fits, state)

    def placed(part, target, rows, state):
        held = part.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [_binary_rows(target), pa.array(np.full(len(rows), state, np.int8)), held.column("word"), held.column("n")],
            names=["cell", "state", "word", "n"],
        )

    routed = words.select("word", "n").mapInArrow(route, "cell binary, state tinyint, word string, n long")
    # Only cells of over so many words are named here, so there are fewer of them than words / cell.
    letters = F.sum(F.char_length("word"))
    parts = F.greatest(F.ceil(F.count("*") / cell), F.ceil(letters / CELL_BYTES)).cast("int")
    sizes = routed.filter("state = -1").groupBy("cell").agg(F.least(parts, F.count("*")).alias("parts")).filter("parts > 1")
    dealt = routed.join(F.broadcast(sizes), "cell", "left").fillna(1, ["parts"])
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    block = F.when(F.col("state") < 0, F.array(mine)).otherwise(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    dealt = dealt.withColumn("block", F.explode(block)).drop("parts")
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "state")

    def search(batches):
        group, held, held_n, trie = None, [], [], None
        for batch in batches:
            cells, blocks, states = batch.column("cell"), batch.column("block"), batch.column("state")
            for low, high in _runs(cells, blocks, states):
                name = (cells[low].as_py(), blocks[low].as_py())
                if name != group:
                    group, held, held_n, trie = name, [], [], None
                part = batch.slice(low, high - low)
                if states[low].as_py() < 0:
                    held.append(part.column("word"))
                    held_n.append(part.column("n"))
                    continue
                if not held:
                    continue
                if trie is None:
                    index, index_n = pa.concat_arrays(held), pa.concat_arrays(held_n)
                    trie = Cell(index, own, groups, levels)
                for at, n in row_slices(part.column("word"), SLICE):
                    some = part.slice(at, n)
                    ask, hold = trie.near(some.column("word"), some.column("state").to_numpy())
                    if len(ask):
                        a, b = some.take(pa.array(ask)), pa.array(hold)
                        yield pa.RecordBatch.from_arrays([a.column("word"), a.column("n"), index.take(b), index_n.take(b)], names=["a", "a_n", "b", "b_n"])

    found = dealt.mapInArrow(search, "a string, a_n long, b string, b_n long")
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return found.select(F.explode(sides).alias("side")).select("side.*")


def _runs(cells, blocks, states):
    """First and next row of each run of equal cell, block and kind of row."""
    n = len(cells)
    if not n:
        return []
    new = pc.or_(pc.not_equal(cells[1:], cells[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
    kind = states.to_numpy() < 0
    cuts = np.concatenate([[0], np.flatnonzero(new | (kind[1:] != kind[:-1])) + 1, [n]])
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def variant_groups(words: DataFrame, ratio: int = RATIO, groups: int = GROUPS, levels: int | None = None, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a table (word, n) of distinct words."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words, groups, levels, cell)
    none = F.lit(None)
    own = words.select("word", "n", none.cast("string").alias("near"), none.cast("long").alias("near_n"))
    both = own.unionByName(pairs.withColumn("n", none.cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    seen = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = stored(
        seen.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")),
        "formed",
    )
    links = math.log(formed.agg(F.max("n")).first()[0] or 1, ratio)
    steps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links + 1))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13(spark, sf_dir):
    """The spelling variants among the words of all documents, one in 31 run spoilt by the contract's rule."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = word_counts(documents, key="doc_id")
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
