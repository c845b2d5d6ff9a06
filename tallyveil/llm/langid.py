"""Language identification by n-gram filters whose slots hold one bit for each language.

Training takes the word-bound character n-grams of a bounded sample of documents per language and keeps those that at
least ``share`` of the language's sampled documents hold. All languages share one Bloom filter in bit-sliced form:
slot ``h(ngram)`` is a mask with a bit for each language, and the AND of an n-gram's slots gives every language that
holds it at once. A document counts, for each language, its n-grams with the bit set. As a language whose slots are
more often set is hit more often by chance, each count is corrected by that language's rate of false positives before
the largest decides.

Results: null text, or a text with no letter, is ``und`` with score 0. A text none of whose n-grams is known gets the
language with the most training rows, score 0. Equal counts go to the language first in byte order. Rows repeat as they
come; a null key gives a null key, never trains and counts as not held out. An empty table gives no rows; with no
trained language every text is ``und``. Texts are worked on whole, in blocks cut between words.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import crc_fold, gram_blocks, kept_columns, mixed, row_slices, row_sums, sampled_ids

#: Lengths of the n-grams in bytes of lower-cased words, each with one space before and after it.
SIZES = (3, 5)
#: Documents of each language that training reads at most, by smallest hash of the key.
TRAIN_DOCS = 2_000
#: An n-gram belongs to a language if this share of the sampled documents holds it.
SHARE = 0.004
PROBES = 3
#: Bytes of text that a task works on at once; a longer text is held alone.
SLICE = 2 << 20
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class LanguageFilters:
    """languages: in byte order; slots: slot by mask word; rates: false positives by language; usual: the fallback."""

    languages: tuple[str, ...]
    slots: np.ndarray
    rates: np.ndarray
    usual: int


def _gram_blocks(texts):
    """For each block of a column: the hashes of its n-grams and their rows."""
    return gram_blocks(pc.utf8_lower(pc.fill_null(texts, "")), _LETTER, SIZES)


def _counts(batches):
    """(language, n-gram, documents) of each slice of a batch."""
    for batch in (whole.slice(at, n) for whole in batches for at, n in row_slices(whole.column("text"), SLICE)):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        held: dict[int, list] = {}
        for grams, rows in _gram_blocks(batch.column("text")):
            if len(rows):
                bounds = np.searchsorted(rows, np.arange(int(rows[0]), int(rows[-1]) + 2))
                for i in np.flatnonzero(np.diff(bounds)):
                    held.setdefault(int(rows[0]) + int(i), []).append(np.unique(grams[bounds[i] : bounds[i + 1]]))
        per_lang = {name: [] for name in names}
        for row, parts in held.items():
            per_lang[langs[row]].append(np.unique(np.concatenate(parts)))
        for name, parts in per_lang.items():
            if parts:
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def _slots(grams: np.ndarray, size: int):
    """The slots of each n-gram, one array per probe."""
    step = mixed(grams + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for i in range(PROBES):
        yield ((grams + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, train_docs: int = TRAIN_DOCS, share: float = SHARE) -> LanguageFilters:
    """Filters from rows with a language whose crc32 fold is not the held-out one.

    The driver gets the n-grams above ``share``: at most average n-grams of a document / share for each language.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("key"), folds) != held_out))
    names = sorted((r for r in usable.groupBy("lang").count().collect()), key=lambda r: r["lang"].encode())
    if not names:
        return LanguageFilters((), np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    ids = sampled_ids(usable, "key", "lang", train_docs).dropDuplicates()
    sample = usable.join(F.broadcast(ids), ["key", "lang"], "left_semi").select("lang", "text")
    least = {r["lang"]: max(2 if r["count"] > 1 else 1, int(np.ceil(share * min(train_docs, r["count"])))) for r in names}
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("lang")]
    grams = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = grams.filter(F.col("n") >= bound).select("lang", "gram").toPandas()
    languages = tuple(r["lang"] for r in names)
    by_lang = {k: v["gram"].to_numpy().view(np.uint64) for k, v in kept.groupby("lang")}
    most = max([1, *map(len, by_lang.values())])
    size = 1 << max(12, int(np.ceil(np.log2(16 * most))))
    words = -(-len(languages) // 64)
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= bits)
    slots = np.zeros((words, size), kind)
    rates = np.zeros(len(languages))
    for i, name in enumerate(languages):
        word, bit = divmod(i, 64)
        mine = np.zeros(size, bool)
        for slot in _slots(by_lang.get(name, np.zeros(0, np.uint64)), size):
            mine[slot] = True
        slots[word][mine] |= kind(1 << bit)
        rates[i] = mine.mean() ** PROBES
    usual = max(range(len(names)), key=lambda i: (names[i]["count"], -i))
    return LanguageFilters(languages, slots, rates, usual)


def predict_batch(model: LanguageFilters, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the language's number, its share of all corrected counts, its share of the n-grams."""
    n, found = len(texts), len(model.languages)
    hits, total = np.zeros((n, found)), np.zeros(n)
    size = model.slots.shape[1]
    for grams, rows in _gram_blocks(texts):
        bounds = np.searchsorted(rows, np.arange(int(rows[0]), int(rows[-1]) + 2)) if len(rows) else None
        if bounds is None:
            continue
        here = slice(int(rows[0]), int(rows[-1]) + 1)
        total[here] += np.diff(bounds)
        places = list(_slots(grams, size))
        for w in range(len(model.slots)):
            mask = model.slots[w][places[0]]
            for place in places[1:]:
                mask &= model.slots[w][place]
            for i in range(w * 64, min(found, w * 64 + 64)):
                hits[here, i] += row_sums((mask >> mask.dtype.type(i - w * 64)) & mask.dtype.type(1), bounds)
    true = np.maximum(0, (hits - total[:, None] * model.rates) / (1 - model.rates))
    best = np.where(true.sum(1) > 0, true.argmax(1), model.usual)
    top = true[np.arange(n), best]
    score = np.divide(top, true.sum(1), out=np.zeros(n), where=true.sum(1) > 0)
    known = np.divide(top, total, out=np.zeros(n), where=total > 0)
    return best, np.clip(score, 0, 1), np.clip(known, 0, 1)


def identify(documents: DataFrame, model: LanguageFilters, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred, lang_score and lang_known; see the module for odd texts.

    A kept column of one of these names gives way to it.
    """
    spark = documents.sparkSession
    keep = kept_columns(documents, keep, ("lang_pred", "lang_score", "lang_known"))
    rows = documents.select(*[F.col(c) for c in keep], F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in (whole.slice(at, n) for whole in batches for at, n in row_slices(whole.column("__text"), SLICE)):
            column = batch.column("__text")
            best, score, known = predict_batch(m, column) if m.languages else (np.zeros(len(column), int), np.zeros(len(column)), np.zeros(len(column)))
            none = ~np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool) | (len(m.languages) == 0)
            best, score, known = np.where(none, len(m.languages), best), np.where(none, 0, score), np.where(none, 0, known)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names[best], pa.string()), pa.array(score), pa.array(known)], names=[*keep, "lang_pred", "lang_score", "lang_known"])

    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_known", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def op4(spark, sf_dir):
    """The language of every document, learned from three of four folds."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents)
    rows = identify(documents.select("doc_id", "text"), model, keep=("doc_id",))
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_known").alias("known"))
