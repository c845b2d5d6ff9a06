"""Spelling variants against brute force, on planted and odd rows."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tallyveil.llm import spelling

LETTERS = "abcdefghéüÀ"


def near(a, b):
    """Plain rule: one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n) by comparing all words with all."""
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(close[w]), counts.get(form.get(w))) for w, n in counts.items()}


def slow_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def edited(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(LETTERS) + word[at:], word[:at] + rng.choice(LETTERS) + word[at + 1 :]])


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    out = {}
    for _ in range(60):
        word = "".join(rng.choice(LETTERS) for _ in range(rng.randint(7, 11)))
        out[word] = rng.choice((3, 50, 4000))
        for _ in range(8):
            word = edited(rng, word)
            out.setdefault(word, rng.choice((2, 2, 20, 400)))
    # One group of a hub and its variants, far larger than the others; ties in n; a very long word.
    hub = "abcdefgh"
    out[hub] = 10_000
    out |= {hub[:i] + c + hub[i:]: 3 for i in range(9) for c in LETTERS}
    out |= {"a" * 3000: 5, "a" * 3001: 50}
    return out


@pytest.mark.parametrize("levels, cell, groups", [(None, spelling.CELL, 12), (1, 7, 12), (4, 50, 5), (3, 1000, 3)])
def test_groups_equal_brute_force(spark, words, levels, cell, groups):
    made = spelling.variant_groups(table(spark, words), levels=levels, cell=cell, groups=groups)
    assert got(made) == slow_groups(words)


def test_every_pair_once_from_each_side(spark, words):
    pairs = spelling.near_pairs(table(spark, words), levels=2, cell=20).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs}) == sum(near(a, b) for a in words for b in words)


def test_counts_of_odd_rows(spark):
    rng = random.Random(2)
    line = " ".join("".join(rng.choice("abcé") for _ in range(7)) for _ in range(4000))
    rows = [(1, None), (2, ""), (None, "Variant variant VARIANT"), (3, "variants÷variants"), (3, "variants÷variants"), (4, "Éclair1Éclairs éclairs"), (5, "x" * 50_000 + " " + "x" * 50_000), (6, line), (7, line)]
    table_ = spark.createDataFrame([(k, t, 9, "w") for k, t in rows], "doc_id long, text string, n int, word string")
    found = spelling.word_counts(table_, key="doc_id")
    assert {r["word"]: r["n"] for r in found.collect()} == slow_counts(rows)
    plain = spelling.word_counts(table_).filter("word = 'variant'").first()
    assert plain["n"] == 3
    assert spelling.variant_groups(spelling.word_counts(table_.limit(0))).count() == 0


def test_spoil_takes_one_letter():
    hit = [(k, w) for k in range(400) for w in ("handling",) if zlib.crc32(f"{k}:{w}".encode()) % 31 == 0]
    assert hit and all(len(spelling.spoil(str(k), w, 31)) == 7 for k, w in hit)
    assert spelling.spoil(str(hit[0][0] + 1), "handling", 31) == "handling"


def test_chains_reach_their_root(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "abcdefghijkl": 200_000}
    made = got(spelling.variant_groups(table(spark, chain)))
    assert {r[1] for r in made.values()} == {"abcdefghijkl"}
    with pytest.raises(ValueError):
        spelling.variant_groups(table(spark, chain), ratio=1)


def test_comparisons_of_rows():
    a, b = (spelling._latin(pa.array(x))[0].reshape(2, -1) for x in (["abcabca", "abcdefg"], ["abcabcab", "xbcdefgy"]))
    assert spelling._one_inserted(a, b).tolist() == [True, False]
