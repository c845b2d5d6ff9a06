"""Finding many tokens in many texts.

Each token has a window size: the largest power of two that is not longer than the token. Its
first and its last window together cover the whole token, so the pair of their hashes and the
token's length stand for the token. Per batch of texts, rolling hashes of all windows are made
in a few vector steps (the hash of a double window comes from its two halves), and a fixed-size
bit filter leaves only positions that very likely start a token. What is left is compared with
the tokens themselves: in the task for a small token set, by an equi-join for a large one. No
text is paired with all tokens.
"""

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.patterns import ERROR_MASK
from tallyveil.plans.scale import SMALL_BYTES, SMALL_ROWS, inline_rows, is_small, keep_where, with_once, written

_SEPARATOR = 0xFFFFFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
# Bits of the filter for token sets too large to gather: 32 for each token, from 8 MB up to 64 MB.
FILTER_BITS = (26, 29)
# Tokens that one such filter serves; more tokens have several, each with its own pass over the texts.
FILTER_TOKENS = 1 << 24
# Bits in which filters are merged.
CHUNK = 1 << 19
# Code points that are searched at once; a longer text is searched alone.
SLICE = 1 << 18
# Texts that are masked at once.
MASKED_ROWS = 1_000
# Texts of one scope that one task works on.
SCOPE_ROWS = 100_000
_WORD = 64


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Case folding, one code point to one. No cased character lies beyond the table."""
    table = np.arange(0x20000, dtype=np.uint32)
    for code in range(0x20000):
        char = chr(code)
        if char.isupper() or char.islower() or char.istitle() or char.upper() != char:
            up = char.upper()
            low = (up if len(up) == 1 else char).lower()
            table[code] = ord(low[0]) if len(low) in (1, 2) and (len(low) == 1 or code == 0x130) else code
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _folded(points: np.ndarray) -> np.ndarray:
    table = _fold_table()
    known = points < len(table)
    return np.where(known, table[np.where(known, points, 0)], points)


def fold(text: str) -> str:
    """The text with each character case-folded; its length does not change."""
    return _folded(_code_points(text)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@F.pandas_udf(T.StringType())
def _fold_udf(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def fold_column(text: Column) -> Column:
    return _fold_udf(text)


def _window(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * _SPREAD
    return value ^ (value >> np.uint64(32))


def _window_hashes(points: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Hash of the window at every position, for each wanted size."""
    hashes = _mixed((points.astype(np.uint64) + np.uint64(1)) * _STEP)
    out, size = {}, 1
    while True:
        if size in sizes:
            out[size] = hashes
        if size >= max(sizes, default=0) or len(hashes) <= size:
            return out
        hashes = _mixed(hashes[:-size] * _STEP + hashes[size:])
        size *= 2


def _whole_hash(first: np.ndarray, last: np.ndarray, length) -> np.ndarray:
    return _mixed(first * _STEP + last + np.uint64(length))


def _joined_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts in one array, each followed by a separator, and their starts."""
    parts = [_code_points(t) for t in texts]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    points = np.full(starts[-1], _SEPARATOR, dtype=np.uint32)
    for start, part in zip(starts, parts):
        points[start : start + len(part)] = part
    return points, starts


def token_bits(tokens: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of folded tokens and their positions in the two filters (first window, whole)."""
    points, starts = _joined_points(tokens)
    starts, lengths = starts[:-1], np.diff(starts) - 1
    windows = np.array([_window(n) for n in lengths.tolist()], dtype=np.int64)
    first, whole = np.zeros(len(tokens), dtype=np.uint64), np.zeros(len(tokens), dtype=np.uint64)
    for size, hashes in _window_hashes(points, set(windows.tolist())).items():
        own = np.flatnonzero(windows == size)
        at, n = starts[own], lengths[own]
        first[own] = hashes[at]
        whole[own] = _whole_hash(hashes[at], hashes[at + n - size], n.astype(np.uint64))
    shift = np.uint64(64 - bits)
    return lengths, (first >> shift).astype(np.int64), (whole >> shift).astype(np.int64)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most SLICE code points each, or of one longer text."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE:
            yield low, i
            low, held = i, 0
        held += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


class TokenFilter:
    """Which positions of a text may start a token, and of which length."""

    def __init__(self, bits: int, lengths: list[int], first: np.ndarray, whole: np.ndarray):
        self.bits, self.first, self.whole = bits, first, whole
        self.by_window: dict[int, list[int]] = {}
        for length in lengths:
            self.by_window.setdefault(_window(length), []).append(length)

    def _has(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        word = words[(place >> np.uint64(6)).astype(np.int64)]
        return ((word >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)

    def candidates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Arrays (text number, position, length) over a batch, and the folded texts.

        The hashes of all windows take many times the text's memory, so a batch is searched slice by slice.
        """
        found, folded = [(np.zeros(0, np.int64),) * 3], []
        for low, high in slices(texts):
            number, at, lengths, some = self._of_slice(texts[low:high])
            found.append((number + low, at, lengths))
            folded += some
        number, at, lengths = (np.concatenate(parts) for parts in zip(*found))
        return number, at, lengths, folded

    def _of_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        points, starts = _joined_points(texts)
        points = np.where(points == _SEPARATOR, points, _folded(points))
        found_at, found_len = [], []
        for size, hashes in _window_hashes(points, set(self.by_window)).items():
            may_start = np.flatnonzero(self._has(self.first, hashes))
            for length in self.by_window[size]:
                fits = may_start[may_start + length <= len(points)]
                whole = _whole_hash(hashes[fits], hashes[fits + length - size], length)
                hit = fits[self._has(self.whole, whole)]
                found_at.append(hit)
                found_len.append(np.full(len(hit), length))
        at = np.concatenate(found_at) if found_at else np.zeros(0, dtype=np.int64)
        lengths = np.concatenate(found_len) if found_len else np.zeros(0, dtype=np.int64)
        number = np.searchsorted(starts, at, side="right") - 1
        inside = at + lengths <= starts[number + 1] - 1 if len(at) else np.zeros(0, dtype=bool)
        number, at, lengths = number[inside], at[inside], lengths[inside]
        wanted = set(number.tolist())
        folded = [
            points[starts[i] : starts[i + 1] - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            if i in wanted else ""
            for i in range(len(texts))
        ]
        return number, at - starts[number], lengths, folded


def _filter_of_tokens(tokens: list[str]) -> TokenFilter:
    """Filter of a gathered token set, at least 32 bits wide per token."""
    bits = max(12, min(FILTER_BITS[0], (32 * max(1, len(tokens))).bit_length()))
    lengths, *places = token_bits(tokens, bits)
    first, whole = (np.zeros(1 << (bits - 6), dtype=np.uint64) for _ in range(2))
    for words, place in zip((first, whole), places):
        np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return TokenFilter(bits, sorted(set(lengths.tolist())), first, whole)


_BITS = T.StructType(
    [T.StructField("size", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("whole", T.LongType())]
)


def _token_bits_udf(width: int):
    @F.pandas_udf(_BITS)
    def places(token: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("size", "first", "whole"), token_bits(list(token), width))))

    return places


def _merged_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of one filter or the other, sorted by chunk, or-ed into one binary value for each chunk."""
    name, words = None, None

    def done():
        return pa.RecordBatch.from_pydict({"kind": pa.array([name[0]], pa.int32()), "chunk": pa.array([name[1]], pa.int64()), "words": [words.tobytes()]})

    for batch in batches:
        kind, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "place"))
        chunk = place // CHUNK
        cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(chunk) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(kind)]):
            if low == high:
                continue
            if (kind[low], chunk[low]) != name:
                if name:
                    yield done()
                name, words = (int(kind[low]), int(chunk[low])), np.zeros(CHUNK // 64, dtype=np.uint64)
            at = place[low:high] % CHUNK
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    if name:
        yield done()


def _filter_of_table(folded: DataFrame, tokens: int | None = None) -> TokenFilter:
    """Filter of a token table that is not gathered.

    Its width follows the number of tokens, so that few positions of a text pass by chance. Bits are dealt by chunk and
    merged there; the driver hands on the merged chunks, bounded by the widest filter, and the distinct lengths.
    """
    tokens = folded.count() if tokens is None else tokens
    width = max(FILTER_BITS[0], min(FILTER_BITS[1], (32 * tokens).bit_length()))
    bits = folded.select(_token_bits_udf(width)("folded").alias("b")).select("b.*")
    lengths = [r["size"] for r in bits.select("size").distinct().collect()]
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("place")) for i, c in enumerate(("first", "whole"))]))
    places = bits.select(sides.alias("s")).select("s.kind", "s.place", F.floor(F.col("s.place") / CHUNK).alias("chunk"))
    dealt = places.repartition("kind", "chunk").sortWithinPartitions("kind", "chunk").select("kind", "place")
    both = [np.zeros(1 << (width - 6), dtype=np.uint64) for _ in range(2)]
    for r in dealt.mapInArrow(_merged_chunks, "kind int, chunk long, words binary").collect():
        at = r["chunk"] * (CHUNK // 64)
        both[r["kind"]][at : at + CHUNK // 64] = np.frombuffer(r["words"], dtype=np.uint64)
    return TokenFilter(width, sorted(lengths), *both)


def _filters_of_table(folded: DataFrame) -> list[TokenFilter]:
    """One filter for each FILTER_TOKENS tokens, which are dealt by hash: none gets too full or too large."""
    tokens = folded.count()
    parts = max(1, -(-tokens // FILTER_TOKENS))
    if parts == 1:
        return [_filter_of_table(folded, tokens)]
    part = F.pmod(F.xxhash64("folded"), F.lit(parts))
    return [_filter_of_table(folded.filter(part == i), -(-tokens // parts)) for i in range(parts)]


def folded_tokens(tokens: DataFrame, *keys: str) -> DataFrame:
    """Distinct non-empty folded tokens."""
    folded = tokens.select(*keys, fold_column(F.col("token")).alias("folded"))
    return folded.filter(F.col("folded") != "").distinct()


def leftmost_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (position, length) spans the ones a single pass takes: leftmost first, then longest."""
    taken, end = [], 0
    for at, length in sorted(spans, key=lambda s: (s[0], -s[1])):
        if at >= end:
            taken.append((at, length))
            end = at + length
    return taken


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, end = [], 0
    for at, length in leftmost_longest(spans):
        out += [text[end:at], mask]
        end = at + length
    return "".join(out) + text[end:]


def _gathered(folded: DataFrame) -> list[str]:
    """The tokens themselves; only called within the bounds of ``is_small``."""
    return [r["folded"] for r in folded.select("folded").collect()]


def gathered_within(folded: DataFrame) -> list[str] | None:
    """The tokens themselves, read part by part; None as soon as they pass the bounds."""
    listed, size = [], 0
    for row in folded.select("folded").toLocalIterator():
        listed.append(row["folded"])
        size += len(row["folded"].encode("utf-8", "surrogatepass"))
        if len(listed) > SMALL_ROWS or size > SMALL_BYTES:
            return None
    return listed


def _text_list(texts: Iterable[str | None]) -> list[str]:
    return ["" if t is None else t for t in texts]


def _exact_spans(texts: list[str], token_filter: TokenFilter, tokens: set[str]) -> dict[int, list]:
    spans: dict[int, list] = {}
    number, at, lengths, folded = token_filter.candidates(texts)
    for i, p, n in zip(number.tolist(), at.tolist(), lengths.tolist()):
        if folded[i][p : p + n] in tokens:
            spans.setdefault(i, []).append((p, n))
    return spans


_SPAN = pa.struct([("pos", pa.int32()), ("size", pa.int32()), ("folded", pa.string())])


def _spans_of(texts: list[str], token_filter: TokenFilter) -> pa.Array:
    """The candidates of each text, as one list array without an object for each candidate."""
    number, at, lengths, folded = token_filter.candidates(texts)
    order = np.argsort(number, kind="stable")
    number, at, lengths = number[order], at[order], lengths[order]
    # Texts repeat few tokens, so the slices are dealt as numbers into one list of the distinct ones.
    known: dict[str, int] = {}
    places = [known.setdefault(folded[i][p : p + n], len(known)) for i, p, n in zip(number.tolist(), at.tolist(), lengths.tolist())]
    tokens = pa.array(list(known), pa.string()).take(pa.array(places, pa.int64()))
    found = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(lengths, pa.int32()), tokens], fields=list(_SPAN))
    ends = np.searchsorted(number, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def _candidate_udf(token_filter: TokenFilter):
    @F.arrow_udf("array<struct<pos:int,size:int,folded:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = _text_list(texts.to_pylist())
        parts = [_spans_of(rows[low:high], token_filter) for low, high in slices(rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_SPAN))

    return spans


def _per_token(df: DataFrame, total: Column) -> DataFrame:
    rows = df.select("*", F.explode_outer("__hits").alias("folded")).filter(F.col("folded").isNotNull())
    return rows.groupBy("folded").agg(total.alias("total"))


def matched_tokens(df: DataFrame, column: str, tokens: DataFrame, total: Column) -> DataFrame:
    """(folded, total): an aggregate over the rows whose text contains the token, in any case.

    A row counts once per token. Rows are aggregated per candidate before the candidates are
    confirmed, so a token that a third of all rows contain does not meet in one task.
    """
    folded = folded_tokens(tokens)
    if is_small(folded):
        listed = _gathered(folded)
        token_filter, token_set = _filter_of_tokens(listed), set(listed)

        @F.pandas_udf("array<string>")
        def hits(texts: pd.Series) -> pd.Series:
            rows = _text_list(texts)
            out = [set() for _ in rows]
            number, at, lengths, low = token_filter.candidates(rows)
            for i, p, n in zip(number.tolist(), at.tolist(), lengths.tolist()):
                if low[i][p : p + n] in token_set:
                    out[i].add(low[i][p : p + n])
            return pd.Series([sorted(o) for o in out])

        return _per_token(df.withColumn("__hits", hits(column)), total)
    # A token is in one filter's part; what another filter proposes by chance would count a row twice.
    filters = _filters_of_table(folded)
    part = F.pmod(F.xxhash64("folded"), F.lit(len(filters)))
    found = None
    for i, token_filter in enumerate(filters):
        maybe = df.withColumn("__hits", F.array_distinct(_candidate_udf(token_filter)(column)["folded"]))
        some = _per_token(maybe, total).filter(part == i)
        found = some if found is None else found.unionByName(some)
    # Spark would push the join below the aggregate, where every hit of a frequent token takes part.
    return with_once(found, "folded", F.col("folded")).join(folded, "folded", "left_semi")


def fail_closed(work: Callable[[list], list], rows: list) -> list:
    """The work done on a batch; where it fails, row by row, and a row that fails is masked, never passed."""
    try:
        return work(rows)
    except Exception:
        out = []
        for row in rows:
            try:
                out += work([row])
            except Exception:
                out.append(ERROR_MASK)
        return out


def gathered_layer(tokens: DataFrame, mask: str) -> Callable[[DataFrame, str], DataFrame]:
    """Masks every token in any case, as one pass that prefers the leftmost and then the longest.

    For a token set within bounds: it goes to the tasks, which finish a batch of texts on their own.
    """
    cover_rows = _covering(_gathered(folded_tokens(tokens)), mask)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return pd.Series(cover_rows(list(texts)), dtype=object)

    return lambda df, column: df.withColumn(column, cover(column))


def _covering(listed: list[str], mask: str) -> Callable[[list], list]:
    """Masks the listed tokens in a batch of texts, slice by slice."""
    token_filter, token_set = _filter_of_tokens(listed), set(listed)

    def covered(texts: list) -> list:
        spans = _exact_spans(_text_list(texts), token_filter, token_set)
        return [masked(t, spans[i], mask) if i in spans else t for i, t in enumerate(texts)]

    return lambda rows: [t for low, high in slices(_text_list(rows)) for t in fail_closed(covered, rows[low:high])]


def gathered_lists(listed: list[str], mask: str) -> Callable[[Column], Column]:
    """The same for a column of arrays of texts, from folded tokens that were gathered before: no row moves."""
    cover_rows = _covering(listed, mask)

    @F.arrow_udf("array<string>")
    def cover(lists: pa.Array) -> pa.Array:
        texts = pa.array(cover_rows(lists.flatten().to_pylist()), pa.string())
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts, mask=lists.is_null())

    return cover


def _masking_udf(mask: str):
    """Masks the found spans of a text; null for none."""

    def covered(rows: list) -> list:
        return [t if f is None or len(f) == 0 else masked(t, f, mask) for t, f in rows]

    @F.arrow_udf("string")
    def cover(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for low in range(0, len(texts), MASKED_ROWS):
            some = found.slice(low, MASKED_ROWS)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)).tolist()
            spans = some.flatten()
            pos, size = (spans.field(c).to_pylist() for c in ("pos", "size"))
            each = [list(zip(pos[a:b], size[a:b])) for a, b in zip([0, *ends], ends)]
            out += fail_closed(covered, list(zip(texts.slice(low, MASKED_ROWS).to_pylist(), each)))
        return pa.array(out, pa.string())

    return cover


def joined_layer(tokens: DataFrame, mask: str, by: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """The same for token tables of any size, and for tokens that hold only within a scope.

    Candidates are confirmed by an equi-join on the token (and ``by``). Equal texts of one scope
    are worked on once and found again by their digest. Rows without a candidate take no part in
    the join; for that the texts are searched twice, which moves far less than a shuffle of all.
    A table that needs several filters has its distinct texts written and searched once for each.
    """
    keys = [by] if by else []
    folded = folded_tokens(tokens, *keys)
    distinct_tokens = folded.select("folded").distinct()
    small = is_small(distinct_tokens)
    filters = [_filter_of_tokens(_gathered(distinct_tokens))] if small else _filters_of_table(distinct_tokens)
    cover = _masking_udf(mask)

    def confirmed(candidates: DataFrame) -> DataFrame:
        rows = inline_rows(candidates, "__spans", "__digest", *keys).join(folded, ["folded", *keys], "left_semi")
        return rows.groupBy("__digest", *keys).agg(F.collect_set(F.struct("pos", "size")).alias("__found"))

    def searched(df: DataFrame, column: str, token_filter: TokenFilter) -> DataFrame:
        return df.withColumn("__spans", F.coalesce(_candidate_udf(token_filter)(column), F.array()))

    def apply(df: DataFrame, column: str) -> DataFrame:
        digested = df.withColumn("__digest", F.sha2(F.col(column), 256))
        if len(filters) == 1:
            marked = searched(digested, column, filters[0])
            clean = keep_where(marked, F.size("__spans") == 0).select(*df.columns)
            maybe = keep_where(marked, F.size("__spans") > 0)
            candidates = maybe.select("__digest", *keys, "__spans").dropDuplicates(["__digest", *keys])
            joined = maybe.drop("__spans").join(confirmed(candidates), ["__digest", *keys], "left")
            return clean.unionByName(joined.withColumn(column, cover(F.col(column), F.col("__found"))).select(*df.columns))
        texts = written(digested.select("__digest", *keys, column).filter(F.col(column).isNotNull()).dropDuplicates(["__digest", *keys]), "texts")
        candidates = None
        for token_filter in filters:
            some = searched(texts, column, token_filter).select("__digest", *keys, "__spans")
            candidates = some if candidates is None else candidates.unionByName(some)
        found = written(confirmed(candidates), "found")
        joined = digested.join(found, ["__digest", *keys], "left")
        return joined.withColumn(column, cover(F.col(column), F.col("__found"))).select(*df.columns)

    return apply


def scoped_layer(tokens: DataFrame, mask: str, by: str) -> Callable[[DataFrame, str], DataFrame]:
    """Masks the tokens of each row's own scope, one matcher for each scope.

    Texts and tokens meet by scope: in a task the tokens of a scope come first, then its texts pass by as a stream, so a
    text is compared with its scope's tokens only, however many scopes there are. Scopes with many texts are dealt to
    several tasks, with their tokens in each; scopes whose tokens pass the bounds for gathering are confirmed by a join.
    Texts of no scope stay as they are, where they are.
    """
    folded = folded_tokens(tokens.filter(F.col(by).isNotNull()), by)
    sizes = folded.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.octet_length("folded")).alias("size"))
    # Each of these scopes has over SMALL_ROWS tokens or SMALL_BYTES of them, so they are few.
    large = sizes.filter((F.col("n") > SMALL_ROWS) | (F.col("size") > SMALL_BYTES)).select(by)
    has_large = not large.isEmpty()

    def apply(df: DataFrame, column: str) -> DataFrame:
        rest = df.filter(F.col(by).isNull())
        mine = df.filter(F.col(by).isNotNull())
        few = folded
        if has_large:
            rest = rest.unionByName(joined_layer(tokens.join(F.broadcast(large), by, "left_semi"), mask, by)(mine.join(F.broadcast(large), by, "left_semi").select(*df.columns), column))
            mine = mine.join(F.broadcast(large), by, "left_anti").select(*df.columns)
            few = folded.join(F.broadcast(large), by, "left_anti")
        # Each of these scopes has over SCOPE_ROWS texts, so they are few.
        busy = mine.groupBy(by).agg(F.ceil(F.count("*") / SCOPE_ROWS).cast("int").alias("__tasks")).filter("__tasks > 1")
        busy = F.broadcast(busy)
        each = F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1)).alias("__task")
        held = few.join(busy, by, "left").select(by, each, F.col("folded").alias("__token"))
        asked = mine.join(busy, by, "left").withColumn("__task", F.pmod(F.xxhash64(column, F.spark_partition_id()), F.coalesce("__tasks", F.lit(1))).cast("int"))
        other = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != by]
        both = held.select(by, *other, "__task", "__token").select(*df.columns, "__task", "__token")
        both = both.unionByName(asked.select(*df.columns, "__task", F.lit(None).cast("string").alias("__token")))
        dealt = both.withColumn("__scope", F.col(by).cast("string")).repartition("__scope", "__task")
        dealt = dealt.sortWithinPartitions("__scope", "__task", F.col("__token").asc_nulls_last())
        return dealt.mapInArrow(_scope_stream(df.columns, column, mask), df.schema).unionByName(rest)

    return apply


def _scope_stream(columns: list[str], column: str, mask: str):
    """Masks texts that come after the tokens of their scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, token_filter = None, [], None

        def covered(texts: list) -> list:
            spans = _exact_spans(_text_list(texts), token_filter, held_set)
            return [masked(t, spans[i], mask) if i in spans else t for i, t in enumerate(texts)]

        for batch in batches:
            if not batch.num_rows:
                continue
            scope, task, token = (batch.column(c) for c in ("__scope", "__task", "__token"))
            kind = token.is_valid().to_numpy(zero_copy_only=False)
            new = pc.or_(pc.not_equal(scope[1:], scope[:-1]), pc.not_equal(task[1:], task[:-1])).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(new | (kind[1:] != kind[:-1])) + 1
            out = batch.column(column).to_pylist()
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                own = (scope[low].as_py(), task[low].as_py())
                if own != name:
                    name, held, token_filter = own, [], None
                if kind[low]:
                    held += token[low:high].to_pylist()
                    continue
                if held and token_filter is None:
                    token_filter, held_set = _filter_of_tokens(held), set(held)
                if held:
                    out[low:high] = fail_closed(covered, out[low:high])
            texts = pa.array(out, batch.schema.field(column).type)
            made = pa.RecordBatch.from_arrays([texts if c == column else batch.column(c) for c in columns], names=columns)
            yield made.filter(pa.array(~kind))

    return run
