"""Quality classifier: supervised subword embeddings.

Every word, every pair of neighbouring words (all repetitions of a word are one pair) and every word-bound character
n-gram is hashed to a row of a table of learned vectors. A document is the average of its vectors; a softmax layer turns it into
the probability of label 1. Table and layer are trained together by numpy stochastic gradient descent, in one task,
on a sample of labelled documents that is bounded by ``train_docs`` per label and chosen by hash. The features of the
sample are hashed counts, so that a very long text is no larger than the table.

As the layer is linear in the average, scoring needs only each feature's pull on the two classes: a table of one number
per bucket goes to the tasks, and whole texts are scored in blocks cut between words.

Results: null and empty texts, and texts of white space only, have no features; they get the share of label 1 in the
sample, as does every text if the sample has one label only, or 0.5 without labels. Rows repeat as they come; null keys
never train and are not held out; rows of labels with a null key or label are left out; if a key has several labels,
each counts. Empty tables give no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import WHITE, blocks, crc_fold, gram_blocks, kept_columns, mixed, row_bounds, row_slices, row_sums, sampled_ids, span_hashes, text_bytes, word_spans

#: Labelled documents that training takes of each label at most.
TRAIN_DOCS = 2_000
#: Buckets of the vector table, a power of two.
BUCKETS = 1 << 17
SIZES = (3, 4)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
DIM = 8
#: Updates of a training run, whatever the number of documents.
UPDATES = 24_000
RATE = 0.2
SEED = 11
#: Bytes of text that a task works on at once; a longer text is held alone.
SLICE = 2 << 20


@dataclass(frozen=True)
class Embeddings:
    """vectors: bucket by dimension; layer: class by dimension, with bias; base: the share of label 1."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    base: float

    def pull(self) -> np.ndarray:
        """What a feature adds to the margin of label 1 over label 0."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)


def features(column):
    """(bucket, row) arrays of each block; rows rise within each array."""
    most = np.uint64(BUCKETS - 1)
    for grams, rows in gram_blocks(column, ~WHITE, SIZES):
        yield (grams & most).astype(np.int64), rows
    data, offsets = text_bytes(column)
    inside = ~WHITE[data]
    before: tuple = (-1, 0)
    for at, stop in blocks(~inside, offsets):
        starts, ends = word_spans(inside[at:stop], offsets[(offsets >= at) & (offsets < stop)] - at)
        words = span_hashes(data[at:stop], starts, ends)
        rows = np.searchsorted(offsets, starts + at, side="right") - 1
        if not len(rows):
            continue
        yield (words & most).astype(np.int64), rows
        # A row's first word has no neighbour before it; one cut by the block's edge has.
        last_row = np.concatenate([[before[0]], rows[:-1]])
        last_word = np.concatenate([np.array([before[1]], np.uint64), words[:-1]])
        has = last_row == rows
        # The second word of a pair is written relative to the first: a repetition is one bigram, whatever the word.
        pair = np.where(last_word == words, _PAIR, mixed(last_word * _PAIR + words))[has]
        yield (pair & most).astype(np.int64), rows[has]
        before = (int(rows[-1]), words[-1])


def _bags(batches):
    """Each labelled text as buckets with counts."""
    for batch in (whole.slice(at, n) for whole in batches for at, n in row_slices(whole.column("text"), SLICE)):
        n = batch.num_rows
        parts: list[list] = [[] for _ in range(n)]
        for bucket, rows in features(batch.column("text")):
            if len(rows):
                here, bounds = row_bounds(rows)
                for i in np.flatnonzero(np.diff(bounds)):
                    parts[here.start + i].append(bucket[bounds[i] : bounds[i + 1]])
        made = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("key"), pa.array([b.astype(np.int32).tobytes() for b, _ in made], pa.binary()), pa.array([(c / c.sum()).astype(np.float32).tobytes() if len(c) else b"" for _, c in made], pa.binary())],
            names=["label", "key", "buckets", "weights"],
        )


def fit(labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED) -> Embeddings:
    """Stochastic gradient descent over documents given as (buckets, weights that sum to 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.uniform(-1 / DIM, 1 / DIM, (2, DIM)), np.zeros(2)
    base = float(labels.mean()) if len(labels) else 0.5
    use = [i for i, (b, _) in enumerate(bags) if len(b)]
    if len(set(labels[use].tolist())) < 2:
        return Embeddings(vectors * 0, layer, bias, base)
    # The rarer label weighs as much as the other.
    weight = len(use) / (2 * np.bincount(labels[use], minlength=2))
    done = 0
    while done < UPDATES:
        for i in rng.permutation(use)[: UPDATES - done]:
            rate = RATE * (1 - done / UPDATES)
            buckets, share = bags[i]
            hidden = share @ vectors[buckets]
            z = layer @ hidden + bias
            z = np.exp(z - z.max())
            gap = z / z.sum()
            gap[labels[i]] -= 1
            gap *= weight[labels[i]]
            back = gap @ layer
            layer -= rate * np.outer(gap, hidden)
            bias -= rate * 0.1 * gap
            # Divided by the squared norm of the weights, the step moves the average alike for short and long texts.
            vectors[buckets] -= rate * (share / (share @ share))[:, None] * back
            done += 1
    return Embeddings(vectors.astype(np.float32), layer, bias, base)


def _fit_task(batches):
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "buckets", "weights")))]
    rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    model = fit(np.array([r[1] for r in rows], np.int64), [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows])
    yield pa.RecordBatch.from_pydict({"vectors": [model.vectors.astype(np.float32).tobytes()], "layer": [model.layer.tobytes()], "bias": [model.bias.tobytes()], "base": [model.base]})


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held_out: int = 1, train_docs: int = TRAIN_DOCS) -> Embeddings:
    """A model from labelled rows whose crc32 fold is not the held-out one; the driver gets the model only."""
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (crc_fold(F.col("key"), folds) != held_out)).dropDuplicates()
    chosen = sampled_ids(marks, "key", "label", train_docs)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    bags = rows.select("label", F.col("key").cast("string").alias("key"), "text").mapInArrow(_bags, "label int, key string, buckets binary, weights binary")
    bags = bags.orderBy(F.xxhash64("key", "buckets")).limit(2 * train_docs)  # the bound holds for repeated keys too
    found = bags.repartition(1).mapInArrow(_fit_task, "vectors binary, layer binary, bias binary, base double").first()
    return Embeddings(np.frombuffer(found["vectors"], np.float32).reshape(BUCKETS, DIM), np.frombuffer(found["layer"]).reshape(2, DIM), np.frombuffer(found["bias"]), found["base"])


def score_batch(pull: np.ndarray, lean: float, base: float, column) -> np.ndarray:
    """The probability of label 1 for each text of a column; ``pull`` all zero gives the base."""
    n = len(column)
    total, count = np.zeros(n), np.zeros(n)
    for bucket, rows in features(column):
        if len(rows):
            here, bounds = row_bounds(rows)
            total[here] += row_sums(pull[bucket].astype(np.float64), bounds)
            count[here] += np.diff(bounds)
    margin = np.divide(total, count, out=np.zeros(n), where=count > 0) + lean
    score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.where((count > 0) & bool(pull.any()), score, base)


def score(documents: DataFrame, model: Embeddings, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) with quality_score, the probability of label 1; a column of that name gives way."""
    keep = kept_columns(documents, keep, ("quality_score",))
    shared = documents.sparkSession.sparkContext.broadcast((model.pull(), float(model.bias[1] - model.bias[0]), model.base))

    def run(batches):
        for batch in (whole.slice(at, n) for whole in batches for at, n in row_slices(whole.column("__text"), SLICE)):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score_batch(*shared.value, batch.column("__text")))], names=[*keep, "quality_score"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*[documents.schema[c] for c in keep], T.StructField("quality_score", T.DoubleType())]))


def op1(spark, sf_dir):
    """The quality score of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(documents.select("doc_id", "text"), model, keep=("doc_id",))
    held = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
