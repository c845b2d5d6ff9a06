"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens: a run of non-white bytes, with the one space before it if there is one; the white space left over. They
cover each byte of a text once and are segmented whole, however long; n_pretokens counts one for each ``LONGEST`` bytes
begun.

The model: pieces are the entries of a public byte-pair vocabulary, which holds every byte; the probability of a piece
follows Zipf's law in its rank. A pre-token's segmentation is the one with the largest sum of log probabilities, kept as
whole micro-units so that sums are exact; of equal ones the one with fewer pieces counts.

The distinct pre-tokens of a slice of texts form a trie. Its nodes of one depth are made and scored together: a node's forward
score is the best of its ancestors' scores plus the piece between them, so a prefix shared by many pre-tokens is scored
once. The counts at the terminal nodes then go back to the texts. Pre-tokens over ``LONGEST`` bytes, which share little,
are scored one by one with the same recursion over their pieces. Memory is that of one slice's pre-tokens.

Results: null and empty texts have no tokens. Every row has its own result; an empty table gives no rows.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import BYTE_CODES, WHITE, blocks, kept_columns, row_slices, row_sums, span_hashes, text_bytes

#: Bytes of a piece at most, and of a pre-token that goes into the trie.
LONGEST = 128
#: Bytes of a longer pre-token whose pieces are looked up at once.
STRETCH = 1 << 14
#: Bytes of text whose pre-tokens make one trie; a longer text makes its own.
SLICE = 8 << 20
#: Zipf's shift of the ranks.
SHIFT = 2.7
MICRO = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def piece_scores(path: str | None = None) -> dict[bytes, int]:
    """Log probabilities in micro-units of the vocabulary's pieces."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = np.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {piece: -round(MICRO * (np.log(rank + SHIFT) + whole)) for piece, rank in ranks.items() if len(piece) <= LONGEST}


class Pieces:
    """Scores of pieces by hash, with a bitmap in front that most strings fail."""

    def __init__(self, scores: dict[bytes, int]):
        found = {}
        for piece, score in scores.items():
            value = 0
            for i in piece:
                value = (value * int(_STEP) + int(BYTE_CODES[i])) & ((1 << 64) - 1)
            found[value] = score
        self.hashes = np.array(sorted(found), np.uint64)
        self.scores = np.array([found[int(h)] for h in self.hashes], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes >> np.uint64(42)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and their scores."""
        likely = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), len(self.hashes) - 1)
        real = self.hashes[at] == hashes[likely]
        return likely[real], self.scores[at[real]]


@lru_cache(maxsize=1)
def _pieces(path: str | None) -> Pieces:
    """A worker's table of pieces, kept from task to task."""
    return Pieces(piece_scores(path))


def pre_token_spans(white: np.ndarray, space: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens; ``heads`` are the first bytes of rows."""
    n = len(white)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[0] = first[0] = True
    first[1:n] = white[1:] != white[:-1]
    # A space before a word is the word's.
    to_word = np.flatnonzero(first[1:n] & ~white[1:] & space[:-1] & ~head[1:n]) + 1
    first[to_word] = False
    first[to_word - 1] = True
    first |= head
    first[n] = False
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


def long_count(data: np.ndarray, pieces: Pieces) -> int:
    """Pieces in the best segmentation of one span of any length; of its scores the last ``LONGEST`` are kept."""
    n, code = len(data), BYTE_CODES[data]
    # A score's micro-units stand above 32 bits from which each piece takes one.
    none = -(1 << 200)
    ahead = [0] + [none] * LONGEST
    for at in range(0, n, STRETCH):
        m = min(STRETCH, n - at)
        best = ahead + [none] * m
        value, found = np.zeros(m, np.uint64), []
        for size in range(1, min(LONGEST, n - at) + 1):
            k = min(m, n - at - size + 1)
            value = value[:k] * _STEP + code[at + size - 1 : at + size - 1 + k]
            first, gain = pieces.look_up(value)
            found.append((first, first + size, gain << 32))
        first, last, gain = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(first, kind="stable")
        for i, j, g in zip(first[order].tolist(), last[order].tolist(), gain[order].tolist()):
            score = best[i] + g - 1
            if score > best[j]:
                best[j] = score
        ahead = best[m:]
    return -ahead[0] & 0xFFFFFFFF


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Pieces in the best segmentation of each span, by one pass over the levels of a trie."""
    out = np.zeros(len(starts), np.int64)
    length = ends - starts
    node = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(length > 0)
    # By node: the best scores and counts of it and its ancestors, and the hashes of the strings from them down to it.
    score, count = np.zeros((1, 1), np.int64), np.zeros((1, 1), np.int64)
    strings = np.zeros((1, 0), np.uint64)
    depth = 0
    while len(live):
        byte = data[starts[live] + depth].astype(np.int64)
        keys, child = np.unique(node[live] * 256 + byte, return_inverse=True)
        parent, code = keys >> 8, BYTE_CODES[keys & 255]
        depth += 1
        # strings[:, i] is the string of the last i + 1 bytes.
        strings = np.concatenate([np.zeros((len(keys), 1), np.uint64), strings[parent][:, : LONGEST - 1]], axis=1) * _STEP + code[:, None]
        above, steps = score[parent], count[parent]
        best = np.full(len(keys), np.iinfo(np.int64).min)
        least = np.zeros(len(keys), np.int64)
        for back in range(strings.shape[1]):
            at, gain = pieces.look_up(strings[:, back])
            value, used = above[at, back] + gain, steps[at, back] + 1
            better = (value > best[at]) | ((value == best[at]) & (used < least[at]))
            best[at[better]], least[at[better]] = value[better], used[better]
        score = np.concatenate([best[:, None], above[:, : LONGEST - 1]], axis=1)
        count = np.concatenate([least[:, None], steps[:, : LONGEST - 1]], axis=1)
        node[live] = child
        ended = length[live] == depth
        out[live[ended]] = least[child[ended]]
        live = live[~ended]
    return out


def count_batch(pieces: Pieces, column) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each text of a column."""
    data, offsets = text_bytes(column)
    white, space = WHITE[data], data == 32
    # Blocks may be cut where white space begins: no pre-token reaches over such a place.
    cut = white.copy()
    cut[1:] &= ~white[:-1]
    spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at, stop in blocks(cut, offsets):
        heads = offsets[(offsets >= at) & (offsets < stop)] - at
        starts, ends = pre_token_spans(white[at:stop], space[at:stop], heads)
        spans.append((starts + at, ends + at, span_hashes(data[at:stop], starts, ends)))
    starts, ends, hashes = (np.concatenate([s[i] for s in spans]) for i in range(3))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    long_ = ends[first] - starts[first] > LONGEST
    found = np.zeros(len(first), np.int64)
    found[~long_] = trie_counts(data, starts[first[~long_]], ends[first[~long_]], pieces)
    found[long_] = [long_count(data[starts[i] : ends[i]], pieces) for i in first[long_]]
    bounds = np.searchsorted(starts, offsets)
    return row_sums(found[which], bounds), np.diff(bounds)


def count_tokens(documents: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The kept columns (all by default) with n_tokens and n_pretokens; columns of these names give way.

    ``vocabulary`` is the path of a rank file.
    """
    keep = kept_columns(documents, keep, ("n_tokens", "n_pretokens"))

    def run(batches):
        pieces = _pieces(vocabulary)
        for batch in batches:
            for at, n in row_slices(batch.column("__text"), SLICE):
                part = batch.slice(at, n)
                tokens, parts = count_batch(pieces, part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(tokens), pa.array(parts)], names=[*keep, "n_tokens", "n_pretokens"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*[documents.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())]))


def op6(spark, sf_dir):
    """Unigram token counts of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(documents.select("doc_id", "text"), keep=("doc_id",))
