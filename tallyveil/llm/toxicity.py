"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters, lower-cased; a token's features are its whole form and its first three to eight bytes, hashed.
Training, in one task on a sample bounded by ``train_docs`` per label and ``TRAIN_BYTES`` per text:

1. Labelled tokens. A feature is a marker if its document counts in toxic and clean texts could hardly be chance (log
   likelihood ratio against the number of features) and it is nearly always toxic. In toxic texts the tokens with a
   marker are toxic, all others clean; toxic texts without a marker say nothing about tokens and are left out.
2. The field has two states. Its emission weights and transitions are fitted by stochastic gradient descent on the
   conditional likelihood, the expected counts coming from forward-backward.
3. A logistic layer turns the largest marginal and the sum of the marginals of a text into its score; it is fitted on
   the labels of all sampled texts.

Scoring runs forward-backward over every token of every text. With two states both passes are recursions of one ratio,
taken in step by all texts of a slice of bounded size. A span is a run of tokens with marginals of one half or more.

Results: texts that are null or without letters have no spans and the score that the layer gives to no evidence. If the
sample has one label only, or none, every text scores its share of toxic texts (0 without labels) and has no spans.
Rows repeat as they come; null keys never train and are not held out; labels with a null key or label are left out.
Empty tables give no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import LOWER, blocks, crc_fold, kept_columns, row_slices, sampled_ids, span_hasher, stored, text_bytes, word_spans

#: Labelled documents that training takes of each label at most, and bytes of such a text at most.
TRAIN_DOCS = 1_500
TRAIN_BYTES = 8_192
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 8)
EPOCHS = 3
RATE = 0.3
#: Bytes of text whose tokens a task holds at once; a longer text is held alone.
SLICE = 6 << 20
#: What every token's emission starts from.
BIAS = -3.0
SEED = 3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Field:
    """weights: by bucket, what a feature adds to the toxic state; moves: state to state; layer: bias and two weights."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    layer: np.ndarray
    base: float
    trained: bool


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of Latin-1 in lower case; lengths stay as they are."""
    out = LOWER[data]
    second = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1 if len(out) else []
    out[second] += 32
    return out


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column's tokens: features (token by feature), first bytes, ends, and each row's bounds among them."""
    data, offsets = text_bytes(column)
    data = lower_bytes(data)
    inside = _LETTER[data]
    found, begins, stops = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, stop in blocks(~inside, offsets):
        starts, ends = word_spans(inside[at:stop], offsets[(offsets >= at) & (offsets < stop)] - at)
        hashed = span_hasher(data[at:stop])
        made = [hashed(starts, ends)]
        for n in PREFIXES:
            # A token shorter than the prefix has its whole form instead.
            made.append(hashed(starts, np.minimum(starts + n, ends)) + np.uint64(n))
        found.append((np.stack(made, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int32))
        begins.append(starts + at)
        stops.append(ends + at)
    begin = np.concatenate(begins)
    return np.concatenate(found), begin, np.concatenate(stops), np.searchsorted(begin, offsets)


def marginals(emission: np.ndarray, bounds: np.ndarray, moves: np.ndarray, start: float, pairs: bool = False):
    """P(toxic) of each token; with ``pairs`` also the expected counts of moves and the rows' first marginals.

    ``emission``: log odds by token; ``bounds``: rows among tokens; ``moves``: log weights by state and next state.
    """
    odds = np.exp(np.clip(emission, -40, 40))
    w = np.exp(moves)
    length = np.diff(bounds)
    rows = np.argsort(-length, kind="stable")
    first = bounds[:-1][rows]
    longest = int(length.max()) if len(length) else 0
    # Rows are sorted by length, so those still running at step t are the first of them.
    running = np.searchsorted(-length[rows], -np.arange(longest), side="left")
    forward, backward = np.zeros(len(emission)), np.ones(len(emission))
    ratio = np.full(len(rows), np.exp(start))
    for t in range(longest):
        n = running[t]
        spot = first[:n] + t
        ratio = ratio[:n]
        if t:
            ratio = (w[0, 1] + ratio * w[1, 1]) / (w[0, 0] + ratio * w[1, 0])
        ratio = ratio * odds[spot]
        forward[spot] = ratio
    for t in range(longest - 2, -1, -1):
        n = running[t + 1]
        spot = first[:n] + t
        after = odds[spot + 1] * backward[spot + 1]
        backward[spot] = (w[1, 0] + w[1, 1] * after) / (w[0, 0] + w[0, 1] * after)
    both = forward * backward
    p = both / (1 + both)
    if not pairs:
        return p
    inner = np.ones(len(emission), bool)
    inner[bounds[1:][length > 0] - 1] = False
    at = np.flatnonzero(inner)
    after = odds[at + 1] * backward[at + 1]
    joint = np.stack([np.full(len(at), w[0, 0]), w[0, 1] * after, w[1, 0] * forward[at], w[1, 1] * forward[at] * after])
    return p, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2), p[bounds[:-1][length > 0]]


def _markers(features: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which buckets mark toxic tokens, by document counts."""
    counts = np.zeros((2, BUCKETS))
    for j in range(features.shape[1]):
        pair = np.unique(rows * BUCKETS + features[:, j])
        np.add.at(counts, (toxic[pair // BUCKETS], pair % BUCKETS), 1)
    clean, bad = counts
    share = toxic.mean()
    rate = np.clip((bad + 1e-9) / (bad + clean + 2e-9), 1e-9, 1 - 1e-9)
    gain = bad * np.log(rate / share) + clean * np.log((1 - rate) / (1 - share))
    return (rate >= 0.9) & (gain >= np.log(max(2, (counts.sum(axis=0) > 0).sum())) + 3)


def _evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By row: a one, the log odds of the largest marginal, the log of their sum."""
    out = np.tile([1.0, -12.0, -12.0], (len(bounds) - 1, 1))
    full = bounds[1:] > bounds[:-1]
    if full.any():
        most = np.clip(np.maximum.reduceat(p, bounds[:-1][full]), 6e-6, 1 - 6e-6)
        out[full, 1] = np.log(most / (1 - most))
        out[full, 2] = np.log(np.maximum(np.add.reduceat(p, bounds[:-1][full]), 6e-6))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly penalised logistic regression, by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grade = x.T @ (p - y) + 0.1 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(weights))
        step = np.linalg.solve(curve, grade)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(features: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, seed: int = SEED) -> Field:
    """A field from texts given by their tokens' features, rows' bounds and labels."""
    weights, moves, start = np.zeros(BUCKETS), np.zeros((2, 2)), -3.0
    base = float(toxic.mean()) if len(toxic) else 0.0
    if len(set(toxic.tolist())) < 2:
        return Field(weights.astype(np.float32), moves, start, np.zeros(3), base, False)
    rows = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    marker = _markers(features, rows, toxic)
    labels = marker[features].any(axis=1) & (toxic[rows] == 1)
    marked = np.bincount(rows, labels, minlength=len(toxic)) > 0
    use = np.flatnonzero((np.diff(bounds) > 0) & (marked | (toxic == 0)))
    rng = np.random.default_rng(seed)
    square = np.full(BUCKETS, 1e-6)
    square_moves = np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(use)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            spots = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            own = np.concatenate([[0], np.cumsum(np.diff(bounds)[some])])
            held = features[spots]
            y = labels[spots]
            p, expected, _ = marginals(BIAS + weights[held].sum(axis=1), own, moves, start, pairs=True)
            gap = p - y
            inner = np.ones(len(spots), bool)
            inner[own[1:] - 1] = False
            here = np.flatnonzero(inner)
            seen = np.bincount(2 * y[here] + y[here + 1], minlength=4).reshape(2, 2)
            grade = np.bincount(held.ravel(), np.repeat(gap, held.shape[1]), minlength=BUCKETS)
            touched = np.unique(held)
            grade = grade[touched] + 1e-3 * weights[touched]
            square[touched] += grade**2
            weights[touched] -= RATE * grade / np.sqrt(square[touched])
            move = (expected - seen) / len(some)
            square_moves += move**2
            moves -= 0.1 * move / np.sqrt(square_moves)
    p = marginals(BIAS + weights[features].sum(axis=1), bounds, moves, start)
    layer = _logistic(_evidence(p, bounds), toxic)
    return Field(weights.astype(np.float32), moves, start, layer, base, True)


def score_batch(field: Field, column) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of the texts of a column, and their toxic spans as first and next character."""
    n = len(column)
    if not field.trained:
        return np.full(n, field.base), [[]] * n
    data, _ = text_bytes(column)
    features, begin, end, bounds = tokens(column)
    emission = np.full(len(features), BIAS)
    for j in range(features.shape[1]):
        emission += field.weights[features[:, j]]
    p = marginals(emission, bounds, field.moves, field.start)
    score = 1 / (1 + np.exp(-np.clip(_evidence(p, bounds) @ field.layer, -500, 500)))
    spans: list[list[dict]] = [[] for _ in range(n)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        row = np.searchsorted(bounds, hot, side="right") - 1
        new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(row) > 0)])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hot)) - 1
        _, offsets = text_bytes(column)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = heads[offsets[:-1]]
        for a, b in zip(first, last):
            i = int(row[a])
            spans[i].append({"start": int(heads[begin[hot[a]]] - base[i]), "end": int(heads[end[hot[b]]] - base[i])})
    return score, spans


def _token_rows(batches):
    for batch in batches:
        features, _, _, bounds = tokens(batch.column("text"))
        made = [features[bounds[i] : bounds[i + 1]].tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(made, pa.binary())], names=["key", "label", "tokens"])


def _fit_task(batches):
    rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "tokens"))))
    parts = [np.frombuffer(r[2], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    features = np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int32), *parts])
    toxic = np.array([r[1] for r in rows], np.int64)
    field = fit(features, bounds, toxic)
    yield pa.RecordBatch.from_pydict({"weights": [field.weights.tobytes()], "moves": [field.moves.tobytes()], "start": [field.start], "layer": [field.layer.tobytes()], "base": [field.base], "trained": [field.trained], "clean": [int((toxic == 0).sum())], "bad": [int((toxic == 1).sum())]})


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Field:
    """A field from labelled rows whose crc32 fold is not the held-out one; the driver gets the model only.

    The sample is drawn from the labels whose texts have at most ``train_bytes``.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (crc_fold(F.col("key"), folds) != held_out)).dropDuplicates()
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") <= train_bytes)
    n = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    marks = stored(marks.join(texts.select("key"), "key", "left_semi"), "labels")
    # Clean texts tell chance from markers, so there are twice as many.
    bad = sampled_ids(marks.filter("label = 1"), "key", "label", train_docs)
    clean = sampled_ids(marks.filter("label = 0"), "key", "label", 2 * train_docs)
    rows = texts.join(F.broadcast(bad.unionByName(clean)), "key").select(F.col("key").cast("string").alias("key"), "label", "text")
    made = rows.mapInArrow(_token_rows, "key string, label int, tokens binary")
    made = made.orderBy(F.xxhash64("key", "tokens")).limit(3 * train_docs)  # the bound holds for repeated keys too
    # The sample holds more toxic texts than the labels do; the layer's bias takes that back.
    found = made.repartition(1).mapInArrow(_fit_task, "weights binary, moves binary, start double, layer binary, base double, trained boolean, clean long, bad long").first()
    used = found["clean"] and found["bad"]
    prior = float(np.log(n[1] / n[0] * found["clean"] / found["bad"])) if used else 0.0
    return Field(np.frombuffer(found["weights"], np.float32), np.frombuffer(found["moves"]).reshape(2, 2), found["start"], np.frombuffer(found["layer"]) + [prior, 0, 0], found["base"], found["trained"])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def score(documents: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) with toxic_score and toxic_spans; columns of these names give way."""
    keep = kept_columns(documents, keep, ("toxic_score", "toxic_spans"))
    shared = documents.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at, n in row_slices(batch.column("__text"), SLICE):
                yield scored(batch.slice(at, n))

    def scored(batch):
        scores, spans = score_batch(shared.value, batch.column("__text"))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores), pa.array(spans, kind)], names=[*keep, "toxic_score", "toxic_spans"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*[documents.schema[c] for c in keep], T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", _SPANS)]))


def op9(spark, sf_dir):
    """The toxicity score and the toxic spans of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(documents.select("doc_id", "text"), field, keep=("doc_id",))
    held = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))
