"""Packing documents into training sequences by lexical retrieval.

1. Tokenising: a text's ids and an end id. Whole windows of a long document are sequences of their own; the rest, its
   tail, is packed. Tails travel as 16-bit ids, so nothing is tokenised twice. The distinct chunks between single spaces
   of a slice of texts are encoded together, by the byte-pair merges of the public vocabulary; merges never cross such a
   place, so the ids are those of the whole text.
2. Token document frequencies over all tails are summed by Spark; the result has one row per vocabulary entry at most.
3. Retrieval: consecutive tails of a task form shards, each with an inverted index weighted by BM25 under the whole
   corpus's frequencies. The next unused document is the seed of a window and queries the index with all its tokens;
   its unused neighbours fill the window, best first. The last one is cut to fit; what is left of it is the next seed.
   A shard's last, short window is split into sequences whose lengths are powers of two, which need no padding.

A shard is bounded by rows and by the window size, a row by one text. There is no shuffle of texts or ids, so no key can
be hot. Shards follow the stored table, so a lost task packs the same again.

Results: null and empty texts consist of the end id. Rows are packed one by one: repeated rows and null keys are
packed each for itself. Equal scores go to the row that comes first. An empty table gives no rows.
"""

import array
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import row_slices, stored

WINDOW = 1_024
#: Tails of a shard at most.
SHARD = 1_024
#: Cached chunks at most, where texts are tokenised one by one.
CACHE = 500_000
#: Bytes of text that are tokenised at once; a longer text stands alone.
TEXTS = 1 << 22
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
END = 0

#: Next to other white space a space does not simply begin the following piece.
_RUNS = re.compile(r"\s\s")
#: The same white space for Arrow, whose own is that of ASCII.
_WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


@lru_cache(maxsize=1)
def _encoder(path: str | None):
    """The byte-pair merges of a rank file and which ids begin with a space, kept by a worker from task to task."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    opens = np.zeros(1 << 16, bool)
    opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, opens


class Tokens(dict):
    """Ids of texts as little-endian 16-bit bytes, under the ranks of a public byte-pair vocabulary.

    It is its own bounded cache: the ids of chunks, each with the space before it.
    """

    def __init__(self, path: str | None = None):
        super().__init__()
        self._encode, self._opens = _encoder(path)
        self._signs = {sign: self._bytes(sign) for sign in ",."}

    def _bytes(self, text: str) -> bytes:
        ids = array.array("H", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """A chunk and the space before it; a sign after letters is a piece of its own."""
        if chunk.endswith((",", ".")) and chunk[:-1].isalpha():
            # The letters alone are cached, the sign's ids are added to them.
            found = self[chunk[:-1]] + self._signs[chunk[-1]]
        else:
            found = self._bytes(" " + chunk)
        if len(self) < CACHE and len(chunk) < 64:
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of one text, its chunks looked up in the cache."""
        if _RUNS.search(text):
            return self._bytes(text)
        first, *chunks = text.split(" ")
        return self._bytes(first) + b"".join(map(self.__getitem__, chunks))

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        """The same for a column, null as empty: its distinct chunks are encoded by one call, each once."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        whole = pc.match_substring_regex(texts, f"{_WHITE}{{2}}")
        words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        first = [self._bytes(t) for t in pc.if_else(whole, texts, flat.take(pa.array(starts[:-1]))).to_pylist()]
        follows = np.ones(len(flat), bool)
        follows[starts[:-1]] = False
        coded = flat.filter(pa.array(follows)).dictionary_encode()
        if not len(coded):
            return first
        held, place = self._encoded(coded.dictionary)
        found = held.take(pa.array(place[coded.indices.to_numpy()]))
        cuts = np.frombuffer(found.buffers()[1], np.int64)[starts - np.arange(len(starts))].tolist()
        data = memoryview(found.buffers()[2])
        return [b"".join((head, data[a:b])) for head, a, b in zip(first, cuts, cuts[1:])]

    def _encoded(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of chunks, each with the space before it, and where in them each chunk's stand.

        In the ids of all chunks joined, one that begins with a space begins a chunk. A chunk whose end is white space would
        meet the space of the next, so these few are encoded one by one and stand last.
        """
        alone = pc.match_substring_regex(chunks, rf"(\A|{_WHITE})\z").to_numpy(zero_copy_only=False)
        place = np.where(alone, np.cumsum(alone) - 1 + (~alone).sum(), np.cumsum(~alone) - 1)
        joined = chunks.filter(pa.array(~alone))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), " ")[0].as_py()
        ids = np.array(self._encode(" " + text) if len(joined) else [], "<u2")
        ends = np.append(np.flatnonzero(self._opens[ids]), len(ids)) * 2
        rest = [self._bytes(" " + c) for c in chunks.filter(pa.array(alone)).to_pylist()]
        ends = np.append(ends, ends[-1] + np.cumsum([len(x) for x in rest], dtype=np.int64)).astype(np.int64)
        data = ids.tobytes() + b"".join(rest)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]), place


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(path: str | None):
    def run(batches):
        tokens = Tokens(path)
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for at, size in row_slices(texts, TEXTS):
                n, windows, tails = [], [], []
                for found in tokens.ids_of(texts.slice(at, size)):
                    ids = np.append(np.frombuffer(found, "<u2"), np.uint16(END))
                    cut = len(ids) // WINDOW * WINDOW
                    n.append(len(ids))
                    windows.append([_crc(ids[i : i + WINDOW]) for i in range(0, cut, WINDOW)])
                    tails.append(ids[cut:].tobytes())
                yield pa.RecordBatch.from_arrays([keys.slice(at, size), pa.array(n, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(tails, pa.binary())], names=["key", "n", "windows", "tail"])

    return run


def _frequencies(batches):
    """How many tails of a partition hold each token, and in the row -1 the tails and their tokens."""
    seen, rows, length = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for tail in batch.column("tail").to_pylist():
            if tail:
                ids = np.frombuffer(tail, "<u2")
                seen[np.unique(ids)] += 1
                rows, length = rows + 1, length + len(ids)
    held = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(seen[held], [rows, length]))], names=["token", "n"])


class Shard:
    """An inverted index of tails; documents leave it when they are used."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(tails)
        parts = [np.unique(t, return_counts=True) for t in tails]
        self.terms = [t for t, _ in parts]
        lengths = np.array([len(t) for t in tails])
        rows = np.repeat(np.arange(self.size), [len(t) for t in self.terms])
        terms = np.concatenate(self.terms).astype(np.int64)
        tf = np.concatenate([c for _, c in parts])
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[rows] / mean))
        order = np.argsort(terms, kind="stable")
        self.rows, self.weight, terms = rows[order], weight[order], terms[order]
        held, first = np.unique(terms, return_index=True)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.first[held], self.count[held] = first, np.diff(np.append(first, len(terms)))

    def neighbours(self, query: int, free: np.ndarray) -> np.ndarray:
        """All free documents, best BM25 score for the query's tokens first, ties by place."""
        terms = self.terms[query]
        count = self.count[terms]
        ends = np.cumsum(count)
        spots = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + count, count)
        score = np.bincount(self.rows[spots], self.weight[spots], minlength=self.size)
        left = np.flatnonzero(free)
        return left[np.argsort(-score[left], kind="stable")]


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float):
    """(document, start in its tail, length, sequence, offset) of each piece."""
    shard = Shard(tails, idf, mean)
    start = np.zeros(len(tails), np.int64)
    left = np.array([len(t) for t in tails])
    free = np.ones(len(tails), bool)
    sequence, seed, pieces = 0, 0, []
    at = 0
    while True:
        if seed < 0:
            while at < len(tails) and not free[at]:
                at += 1
            if at == len(tails):
                break
            seed = at
        room, window = WINDOW, []
        free[seed] = False
        queue, best = [seed], iter(())
        for doc in queue:
            take = min(room, int(left[doc]))
            window.append((doc, int(start[doc]), take))
            start[doc] += take
            left[doc] -= take
            room -= take
            if not room:
                seed = doc if left[doc] else -1
                break
            if len(queue) == 1:
                best = iter(shard.neighbours(seed, free).tolist())
            following = next(best, None)
            if following is None:
                seed = -1
                break
            free[following] = False
            queue.append(following)
        for bits in [WINDOW] if not room else [1 << b for b in range(10, -1, -1) if (WINDOW - room) >> b & 1]:
            offset = 0
            while offset < bits:
                doc, begin, length = window[0]
                take = min(length, bits - offset)
                pieces.append((doc, begin, take, sequence, offset))
                offset += take
                if take == length:
                    window.pop(0)
                else:
                    window[0] = (doc, begin + take, length - take)
            sequence += 1
    return pieces


def _pack(shared):
    def run(batches):
        from pyspark import TaskContext

        idf, mean = shared.value
        sequence = TaskContext.get().partitionId() << 40
        rows: list = []

        def flush():
            nonlocal sequence
            out = []
            for key, n, windows, _ in rows:
                for i, crc in enumerate(windows):
                    out.append((key, i * WINDOW, WINDOW, crc, n, sequence, 0))
                    sequence += 1
            held = [r for r in rows if r[3]]
            if held:
                tails = [np.frombuffer(r[3], "<u2") for r in held]
                pieces = pack_shard(tails, idf, mean)
                for doc, begin, length, seq, offset in pieces:
                    key, n, windows, _ = held[doc]
                    out.append((key, len(windows) * WINDOW + begin, length, _crc(tails[doc][begin : begin + length]), n, sequence + seq, offset))
                sequence += 1 + max(p[3] for p in pieces)
            rows.clear()
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "windows", "tail"))):
                rows.append(row)
                if len(rows) == SHARD:
                    yield flush()
        if rows:
            yield flush()

    return run


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The pieces of all rows; ``vocabulary`` is the path of a rank file on every machine (public one by default)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tokens = stored(rows.mapInArrow(_tokenise(vocabulary), "key long, n long, windows array<long>, tail binary"), "tokens")
    counts = tokens.select("tail").mapInArrow(_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in counts.collect()}  # a row per vocabulary entry at most
    held, length = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(1 << 16)
    for token, n in found.items():
        idf[token] = np.log1p((held - n + 0.5) / (n + 0.5))
    shared = spark.sparkContext.broadcast((idf, max(1.0, length / max(1, held))))
    pieces = tokens.mapInArrow(_pack(shared), "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("key", key)


def op5(spark, sf_dir):
    """All documents packed into windows."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
