"""Language, quality, toxicity and token counts against plain versions and on odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import common, langid, quality, tokencount, toxicity

SYLLABLES = {"aa": "ta ke mi ro lu ve".split(), "bb": "sch ung ber zen oft rau".split(), "cc": "ção nhe lho ria ões gua".split()}
ODD = [None, "", "   \n\t", "?! 12", "x", "\x00   ß", "é" * 5000, "ab " * 40_000]


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Made texts: three languages; low quality is shouted; toxic ones hold a stem of their own."""
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        lang = rng.choice(sorted(SYLLABLES))
        text, bad, toxic = words(rng, lang, rng.randint(20, 60)), rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            parts = text.split(" ")
            parts.insert(rng.randrange(len(parts)), "zworg" + rng.choice(SYLLABLES[lang]))
            text = " ".join(parts)
        rows.append((i, text, lang, f"s{i % 3}", "clash"))
        marks.append((i, int(not bad), int(toxic), "clash"))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    return documents, labels


def odd_rows(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, "ta ke mi", "x"), (3, "same", None), (3, "same", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string")


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def test_language_on_held_out_rows(spark, corpus):
    documents, _ = corpus
    model = langid.train(documents)
    got = langid.identify(documents, model).collect()
    test = [r for r in got if held(r["doc_id"], 4, 2)]
    assert len(test) > 100 and sum(r["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["lang_score"] <= 1 and r["score"] == "clash" for r in got)


def test_language_of_odd_rows(spark, corpus):
    documents, _ = corpus
    got = langid.identify(odd_rows(spark), langid.train(documents)).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        letters = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] != "und") == letters, r
    empty = documents.limit(0)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents.limit(3), langid.train(empty)).collect()} == {"und"}


def test_language_slots_hold_every_gram_of_its_languages(spark, corpus):
    documents, _ = corpus
    model = langid.train(documents, share=0.0, train_docs=10_000)
    text = next(r for r in documents.collect() if not held(r["doc_id"], 4, 2))
    best, score, known = langid.predict_batch(model, pa.array([text["text"]]))
    assert model.languages[best[0]] == text["lang"] and known[0] > 0.85


def test_more_languages_than_one_word_of_bits():
    names = tuple(f"l{i:02d}" for i in range(70))
    slots = np.zeros((2, 1 << 12), np.uint64)
    texts = pa.array(["abc abd"])
    for grams, _ in langid._gram_blocks(texts):
        for slot in langid._slots(grams, 1 << 12):
            slots[1][slot] |= np.uint64(1 << 5)
    best, score, _ = langid.predict_batch(langid.LanguageFilters(names, slots, np.zeros(70), 0), texts)
    assert names[best[0]] == "l69" and score[0] == 1


def test_quality_on_held_out_rows(spark, corpus):
    documents, labels = corpus
    got = quality.score(documents, quality.train(documents, labels)).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [r for r in got if held(r["doc_id"], 3, 1)]
    assert sum((r["quality_score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in test) >= 0.97 * len(test)


def test_quality_of_odd_rows(spark, corpus):
    documents, labels = corpus
    model = quality.train(documents, labels)
    got = quality.score(odd_rows(spark), model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert {r["quality_score"] for r in got if not (r["text"] or "").strip()} == {model.base}
    nothing = quality.train(documents, labels.limit(0))
    assert {r["quality_score"] for r in quality.score(documents.limit(2), nothing).collect()} == {0.5}
    assert quality.score(documents.limit(0), model).count() == 0


def test_features_do_not_depend_on_the_cuts(monkeypatch):
    rng = random.Random(4)
    column = pa.array([words(rng, "cc", 300), None, "word " * 50, words(rng, "bb", 200)])

    def bag(module):
        out: dict = {}
        for bucket, rows in module(column):
            for b, r in zip(bucket.tolist(), rows.tolist()):
                out[r, b] = out.get((r, b), 0) + 1
        return out

    whole = bag(quality.features)
    real = common.blocks
    small = lambda inside, offsets, size=None: real(inside, offsets, 97)
    for module in (common, quality):
        monkeypatch.setattr(module, "blocks", small)
    assert bag(quality.features) == whole


def test_pull_is_the_softmax_of_the_average():
    rng = np.random.default_rng(0)
    bags = [(np.unique(rng.integers(0, 50, 20)), None) for _ in range(40)]
    bags = [(b, np.full(len(b), 1 / len(b), np.float32)) for b, _ in bags]
    labels = np.array([int(7 in b) for b, _ in bags])
    if labels.min() == labels.max():
        labels[0] ^= 1
    model = quality.fit(labels, bags)
    for buckets, share in bags[:5]:
        z = model.layer @ (share @ model.vectors[buckets]) + model.bias
        margin = share @ model.pull()[buckets] + model.bias[1] - model.bias[0]
        assert np.isclose(1 / (1 + np.exp(-margin)), np.exp(z[1]) / np.exp(z).sum(), atol=1e-4)


def test_toxicity_on_held_out_rows(spark, corpus):
    documents, labels = corpus
    got = toxicity.score(documents, toxicity.train(documents, labels)).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [r for r in got if held(r["doc_id"], 3, 1)]
    assert sum((r["toxic_score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in test) >= 0.95 * len(test)
    found = [r["text"][s["start"] : s["end"]].lower() for r in got for s in r["toxic_spans"]]
    assert found and sum("zworg" in x for x in found) >= 0.95 * len(found)


def test_toxicity_of_odd_rows(spark, corpus):
    documents, labels = corpus
    field = toxicity.train(documents, labels)
    got = toxicity.score(odd_rows(spark), field).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert all(not r["toxic_spans"] for r in got if not r["text"])
    untrained = toxicity.train(documents, labels.limit(0))
    assert {r["toxic_score"] for r in toxicity.score(documents.limit(2), untrained).collect()} == {0.0}
    assert toxicity.score(documents.limit(0), field).count() == 0


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 4, 4, 5, 11])
    emission, moves, start = rng.normal(size=11), rng.normal(size=(2, 2)), 0.3
    p, expected, _ = toxicity.marginals(emission, bounds, moves, start, pairs=True)
    want, pairs = np.zeros(11), np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        if not n:
            continue
        weight, mark, count = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = start * y[0] + sum(emission[a + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))
            w = np.exp(s)
            weight += w
            mark += w * np.array(y)
            for i in range(n - 1):
                count[y[i], y[i + 1]] += w
        want[a:b] = mark / weight
        pairs += count / weight
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def slow_count(text, scores):
    """Tokens of a text by the plain rule: pre-tokens by pattern, each by quadratic dynamic programming."""
    total, parts = 0, 0
    for piece in re.findall(rb" ?[^\x09-\x0d ]+|[\x09-\x0d ]+(?= [^\x09-\x0d ])|[\x09-\x0d ]+", text.encode()):
        best = [(0, 0)]
        for end in range(1, len(piece) + 1):
            low = max(0, end - max(map(len, scores)))
            best.append(max((best[i][0] + scores[piece[i:end]], best[i][1] - 1) for i in range(low, end) if piece[i:end] in scores))
        total -= best[-1][1]
        parts += 1
    return total, parts


def test_token_counts_equal_the_plain_rule(spark, monkeypatch):
    rng = random.Random(3)
    texts = [t for t in ODD if not t or len(t) < 10_000]
    texts += ["the theater  there\n\nthen  \n the", " lead and trail ", "a" * 700, "\n\n\n" * 90 + "x", words(rng, "cc", 40), "tabs\tand\r\nlines \t x"]
    texts += ["".join(rng.choice("ab  \n,é") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    scores = tokencount.piece_scores()
    want = [slow_count(t or "", scores) for t in texts]
    for size in (1 << 20, 64):
        real = common.blocks
        monkeypatch.setattr(tokencount, "blocks", lambda cut, offsets, real=real, size=size: real(cut, offsets, size))
        tokens, parts = tokencount.count_batch(tokencount.Pieces(scores), pa.array(texts, pa.string()))
        assert list(zip(tokens.tolist(), parts.tolist())) == want
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, text string, n_tokens string")
    got = tokencount.count_tokens(rows, keep=("k", "n_tokens")).orderBy("k").collect()
    assert [(r["n_tokens"], r["n_pretokens"]) for r in got] == want
    assert tokencount.count_tokens(rows.select("text").limit(0)).count() == 0


def test_long_runs_are_segmented_whole(monkeypatch):
    """Runs over LONGEST bytes against uncut dynamic programming, with characters that lie across its multiples."""
    rng = random.Random(8)
    runs = ["".join(rng.choice("ABCDabcdexyz0189+/") for _ in range(700)), "".join(rng.choice("的一是不了人我在有他") for _ in range(150))]
    runs += ["thereforeinternational" * 20, "\n" * 131 + "\t" * 333, "x" + "é" * 200, "=" * 401, "\n" * 128, "of" * 64, "function" * 17]
    scores = tokencount.piece_scores()
    want = []
    for run in runs:
        data, best = run.encode(), [(0, 0)]
        for end in range(1, len(data) + 1):
            low = max(0, end - max(map(len, scores)))
            best.append(max((best[i][0] + scores[data[i:end]], best[i][1] - 1) for i in range(low, end) if data[i:end] in scores))
        want.append(-best[-1][1])
    pieces = tokencount.Pieces(scores)
    for stretch in (1 << 14, 50):
        monkeypatch.setattr(tokencount, "STRETCH", stretch)
        assert tokencount.count_batch(pieces, pa.array(runs))[0].tolist() == want


def plain_grams(text, sizes, held):
    """Hashes of a text's word-bound n-grams, each with one space before and after its word, by the plain rule."""
    out = []
    words = re.findall(b"[" + re.escape(bytes(held)) + b"]+", text.encode())
    for n in sizes:
        for word in words:
            padded = b" " + word + b" "
            for i in range(len(padded) - n + 1):
                value = n
                for byte in padded[i : i + n]:
                    value = (value * common._ODD + int(common.BYTE_CODES[byte])) % 2**64
                out.append(int(common.mixed(np.array([value], np.uint64))[0]))
    return out, words


def test_language_decision_equals_the_plain_rule(spark, corpus):
    documents, _ = corpus
    model = langid.train(documents)
    texts = [r["text"] for r in documents.limit(40).collect()] + [t for t in ODD if t and len(t) < 100] + ["", "ta sch ção", "Ta KE, mi"]
    best, score, known = langid.predict_batch(model, pa.array(texts))
    for i, text in enumerate(texts):
        grams, _ = plain_grams(text.lower(), langid.SIZES, np.flatnonzero(langid._LETTER).tolist())
        slots = [np.array([s[j] for s in langid._slots(np.array(grams, np.uint64), model.slots.shape[1])]) for j in range(len(grams))]
        true = []
        for k in range(len(model.languages)):
            hits = sum(all(int(model.slots[0][p]) >> k & 1 for p in places) for places in slots)
            true.append(max(0.0, (hits - len(grams) * model.rates[k]) / (1 - model.rates[k])))
        want = int(np.argmax(true)) if sum(true) else model.usual
        assert best[i] == want
        assert score[i] == pytest.approx(min(1, true[want] / sum(true)) if sum(true) else 0)
        assert known[i] == pytest.approx(min(1, true[want] / len(grams)) if grams else 0)


def test_quality_score_equals_the_plain_rule(spark, corpus):
    documents, labels = corpus
    model = quality.train(documents, labels)
    pull, lean = model.pull(), float(model.bias[1] - model.bias[0])
    texts = [r["text"] for r in documents.limit(30).collect()] + ["one one one two", "x", "", " \n", "é ß é é"]
    got = quality.score_batch(pull, lean, model.base, pa.array(texts))
    held = [b for b in range(256) if b not in (9, 10, 11, 12, 13, 32)]
    for text, score in zip(texts, got):
        buckets, words = plain_grams(text, quality.SIZES, held)
        lines = [np.frombuffer(w, np.uint8) for w in words]
        hashes = [common.span_hashes(b, np.array([0]), np.array([len(b)]))[0] for b in lines]
        pairs = [quality._PAIR if a == b else common.mixed(np.array([a], np.uint64) * quality._PAIR + np.array([b], np.uint64))[0] for a, b in zip(hashes, hashes[1:])]
        whole = [int(x) % quality.BUCKETS for x in [*buckets, *hashes, *pairs]]
        want = 1 / (1 + np.exp(-(np.mean([float(pull[b]) for b in whole]) + lean))) if whole else model.base
        assert score == pytest.approx(want, rel=1e-9)


def test_columns_named_like_results_give_way(spark, corpus):
    documents, labels = corpus
    for name, made in (
        ("lang_pred", lambda d: langid.identify(d, langid.train(documents))),
        ("quality_score", lambda d: quality.score(d, quality.train(documents, labels))),
        ("toxic_score", lambda d: toxicity.score(d, toxicity.train(documents, labels))),
    ):
        out = made(documents.limit(5).withColumn(name, F.lit("clash")))
        assert out.columns.count(name) == 1 and "clash" not in {r[name] for r in out.select(name).collect()}


def test_toxicity_learns_from_what_fits(spark, corpus):
    """Long labelled texts are replaced by shorter ones in the draw, and the prior counts the texts that were used."""
    documents, labels = corpus
    long_ = documents.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" "), F.repeat("text", 60))).otherwise(F.col("text")))
    field = toxicity.train(long_, labels, train_docs=40, train_bytes=2_000)
    got = toxicity.score(long_, field).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    test = [r for r in got if held(r["doc_id"], 3, 1)]
    assert field.trained and sum((r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in test) >= 0.95 * len(test)
