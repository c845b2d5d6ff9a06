"""Near-duplicates, mixing, packing, archives and the pipeline against plain versions and on odd rows."""

import gzip
import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import common, mixing, neardup, packing, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def classes(rows, size, percent):
    """Components of all pairs compared in full."""
    sets = {k: shingles(t, size) for k, t in rows}
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_corpus(n=60, seed=1):
    """Groups of copies with a few words changed, a hub among them, one passage in all texts, and tiny texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((5, 30, 120)))]
        for _ in range(rng.choice((1, 1, 2, 6, 25))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + " " + passage)
    texts += ["one", "One", "one two", "one  TWO", "", "a b c d", "A b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    rows = near_corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent).collect()
    want = classes(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_copies_of_one_text_meet_in_their_hub(spark):
    """Copies that all differ from each other more than from the text they came from."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        for at in rng.sample(range(0, 200, 10), 5):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r["component_id"] for r in got} == {0}


def test_twins_among_texts_just_below_the_threshold(spark):
    """A region in which all texts are almost as similar as asked, each of them so to one other text only."""
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(300):
        one = list(base)
        for at in rng.sample(range(0, 200, 5), 5):
            one[at] = f"x{i}-{at}"
        two = list(one)
        for at in rng.sample(range(2, 200, 5), 5):
            two[at] = f"y{i}-{at}"
        texts += [" ".join(one), " ".join(two)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    want = classes(rows, 3, 85)
    assert len({c for _, c in want.values()}) == 300
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("size, percent", [(3, 85), (3, 100), (2, 50)])
def test_sets_of_many_sizes_equal_all_pairs(spark, size, percent):
    """Texts cut to all lengths around the share asked, some of them changed, where the forest may propose none."""
    rng, texts = random.Random(8), []
    for g in range(12):
        base = [f"v{rng.randrange(40)}" for _ in range(rng.choice((8, 20, 60)))]
        for cut in range(0, len(base) // 2, 2):
            one = base[cut:] if rng.random() < 0.5 else base[: len(base) - cut]
            if rng.random() < 0.4:
                one = [*one, f"z{g}-{cut}"]
            texts.append(" ".join(one))
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(rows, size, percent)


def test_a_common_template_gives_no_pairs_of_its_texts(spark, monkeypatch):
    """Pages that differ from a template in one word each: all share its shingles, and none are as similar as asked."""
    met, sides = [], neardup._sides

    def seen(flat, percent):
        small, large = sides(flat, percent)
        met.append(small.join(large, neardup.MEET).count())
        return small, large

    monkeypatch.setattr(neardup, "_sides", seen)
    for n in (150, 600):
        rows = [(i, " ".join(f"u{i}" if j == 2 + i % 32 else f"t{j}" for j in range(36))) for i in range(n)]
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got)
    assert met[1] <= 4 * met[0] + 600


def test_texts_are_shingled_in_slices(monkeypatch):
    """A large batch of texts holds the words of one slice at a time, in the sketch and in the first shingles."""
    texts = [f"w{i} " * (i % 7) + " ".join(f"x{j}" for j in range(i % 40)) for i in range(500)] + [None, "y " * 5_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(502), pa.int64()), pa.array(texts)], names=["key", "text"])
    held, plain = [], neardup.word_hashes
    monkeypatch.setattr(neardup, "word_hashes", lambda column: held.append(sum(len(t or "") for t in column.to_pylist())) or plain(column))
    shared = SimpleNamespace(value=np.zeros(1 << neardup.COUNTED, np.uint32))

    def made():
        sketch = pa.Table.from_batches(neardup._sketch(3)([batch])).to_pylist()
        return sketch, pa.Table.from_batches(neardup._prefixes(3, 85, shared)([batch.rename_columns(["id", "text"])])).to_pylist()

    whole = made()
    held.clear()
    monkeypatch.setattr(neardup, "TEXTS", 4_096, raising=False)
    assert made() == whole
    assert max(h for h in held if h != 10_000) <= 4_096 and held.count(10_000) == 2


def test_the_folder_of_a_local_session_is_private():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local[2]", applicationId="app")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    one, two = (common.shared_folder(session, "x") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    context.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session, "x")


def test_no_intermediate_table_but_those_of_the_result_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark, name, n=iter(range(10**6)): f"{tmp_path}/{name}-{next(n)}")
    rows = spark.createDataFrame(near_corpus(20), "doc_id long, text string")
    neardup.near_duplicates(rows, shingle=3, percent=85).collect()
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["classes", "components", "sketch"]


def test_near_duplicates_of_odd_rows(spark):
    long_ = "x y z " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "a b c"), (6, "A  b\tc"), (7, long_), (8, long_ + "end"), (9, "a b c"), (9, "a b c"), (None, None)]
    table = spark.createDataFrame([(k, t, 0, "z") for k, t in rows], "doc_id long, text string, n long, id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table, shingle=3, percent=60).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 5, False), (7, 3, 7, True), (8, 4, 7, False), (9, 1, 5, False), (9, 1, 5, False)]
    assert [r for r in got if r[0] is not None] == sorted(want, key=str)
    assert sum(r[0] is None and not r[3] for r in got) == 2
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    pairs = [(a, b) for a, b in pairs if a != b]
    top: dict = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}


def word_table(spark, n=3000, seed=3, tail=1.2):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(tail) * 5))), rng.choice(["b", "a", "é", None, "Z"]) if i % 3 else "a") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def plain_targets(size):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full: dict = {}
    while True:
        free = [s for s in size if s not in full]
        left = sum(size.values()) - sum(full.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            return {**full, **{s: weight[s] * level for s in free}}
        full |= {s: 3 * size[s] for s in over}


def test_mix_meets_its_targets(spark):
    table, rows = word_table(spark)
    got = mixing.mix(table).collect()
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    want = plain_targets(size)
    assert len(got) == len(rows) and sum(size.values()) == pytest.approx(sum(want.values()))
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == size[s] and 0 <= r["copies"] <= 3 for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target) <= max(5, 0.002 * target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))


def test_mix_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    table, rows = word_table(spark, 1500, tail=3)
    for s, r in {r["source"]: r for r in mixing.mix(table).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}.items():
        assert abs(r["taken"] - r["target"]) <= max(5, 0.005 * r["target"]), s


def test_targets_stop_at_three_times_a_source(spark):
    table = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), ("d", 10), ("e", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = plain_targets({"a": 1, "b": 100, "c": 1000, "d": 10, "e": 0})
    assert got == pytest.approx(want) and got["a"] == 3


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    size = [float(rng.randint(1, 90)) for _ in range(500)]
    p = [0.37] * 500
    done = mixing.fly(size, p, rng, False)
    assert sum(0 < x < 1 for x in done) <= 2
    assert sum(done) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(done, size)) == pytest.approx(0.37 * sum(size))


def test_inclusion_follows_the_probabilities():
    size, p = [1.0, 2.0, 3.0, 5.0, 8.0, 8.0], [0.2, 0.4, 0.6, 0.5, 0.3, 0.7]
    total = np.zeros(6)
    for seed in range(4000):
        total += np.array(mixing.fly(size, p, random.Random(seed), False))
    assert np.allclose(total / 4000, p, atol=0.04)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (None, "x y", None), (2, "", "b"), (3, "p q r", "b"), (3, "p q r", "b"), (4, " \n", "c")]
    table = spark.createDataFrame([(*r, "z", 9) for r in rows], "doc_id long, text string, source string, key string, size long")
    got = mixing.mix(table).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 8
    assert mixing.mix(table.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mix(table.filter("text IS NULL")).collect()} == {0.0}


def tokens_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_cover_every_token_once(spark):
    rng = random.Random(6)
    words = ["alpha", "beta,", "Gamma.", "d'Ör", "l'été.", "42", "x.y,z", "\nNew", "tab\there", "ß,", "ab12.", "don't", "<|endoftext|>", "²"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 8, 200, 700)))) for _ in range(150)]
    texts += [None, "", " ", "  two  spaces ", " lead", "trail ", "a \n b", "é" * 3000, " wide   x", "tail nb. x"]
    table = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, tail string, n long").repartition(3)
    got = packing.pack(table).collect()
    ids = tokens_of(texts)
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, want in enumerate(ids):
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    windows: dict = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    assert packing.pack(table.limit(0)).count() == 0


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(30)]
    df = np.zeros(1 << 16)
    for t in tails:
        df[np.unique(t)] += 1
    idf, mean = np.log1p((30 - df + 0.5) / (df + 0.5)), np.mean([len(t) for t in tails])

    def score(query, tail):
        s = 0.0
        for term in set(query.tolist()):
            tf = int((tail == term).sum())
            s += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(tail) / mean)) if tf else 0
        return s

    free = np.ones(30, bool)
    free[[4, 9]] = False
    got = packing.Shard(tails, idf, mean).neighbours(4, free).tolist()
    assert got == sorted(np.flatnonzero(free).tolist(), key=lambda i: (-round(score(tails[4], tails[i]), 9), i))


def test_a_chunk_is_encoded_once_while_the_cache_has_room(monkeypatch):
    tokens, asked = packing.Tokens(), []
    plain = tokens._encode
    text = "One word, another word. word, \u00e9t\u00e9, 12. word,"
    whole = tokens._bytes(text)
    tokens._encode = lambda t: asked.append(t) or plain(t)
    assert tokens.ids(text) == whole and tokens.ids(text) == whole
    assert sorted(asked) == sorted(["One", "One", " word", " another", " \u00e9t\u00e9", " 12."])
    monkeypatch.setattr(packing, "CACHE", 0)
    assert packing.Tokens().ids(text) == whole


def test_a_column_is_encoded_by_one_call_for_its_distinct_chunks():
    rng = random.Random(7)
    words = ["alpha", "beta,", "l'\u00e9t\u00e9.", "\nNew", "tab\there", "\u00a0x", "\x1c", "\x1fy", ",", "'s", "\u65e5\u672c", "z" * 70, "end\n", "x\u2003", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [None, "", " ", "a ", "a \n b", " lead"]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(texts, kind).slice(7, 50), pa.array(["one", None], kind), pa.array([], kind)):
            tokens = packing.Tokens()
            assert tokens.ids_of(column) == [tokens._bytes(t or "") for t in column.to_pylist()]
    tokens, asked = packing.Tokens(), []
    plain = tokens._encode
    tokens._encode = lambda t: asked.append(t) or plain(t)
    tokens.ids_of(pa.array(["One word, another word,", "Two another word, 12."]))
    assert sorted(asked) == [" word, another 12.", "One", "Two"]


def test_repeated_rows_are_packed_each(spark):
    table = spark.createDataFrame([(1, "same text")] * 5 + [(None, "x")] * 2, "doc_id long, text string")
    got = packing.pack(table).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 5 * len(tokens_of(["same text"])[0]), None: 2 * len(tokens_of(["x"])[0])}


@pytest.mark.parametrize("version", [1, 2, None])
def test_archives_there_and_back(spark, version, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    big, other = "é" * 700, "<p>" + "x" * 2000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"{other}{i}" if i % 3 == 1 else "small") for i in range(40)]
    rows += [(50, None, None), (51, "http://h/a b\nc", ""), (52, "http://h/ü", other), (53, "u", other), (None, "v", big), (39, "again", big)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    arcs, warcs = common.shared_folder(spark, "arc"), common.shared_folder(spark, "warc")
    warc.write_arc(table, arcs, version=version)
    warc.convert(spark, arcs, warcs)
    got = warc.read_warc(spark, warcs).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    top: dict = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    of = {(r["page_id"], r["record_type"], r["uri"]): r for r in got}
    for i, url, html in rows:
        data = (html or "").encode()
        later = len(data) >= 1000 and i is not None and i < top[html or ""]
        uri = {"http://h/a b\nc": "http://h/a%20b%0Ac", None: "about:blank"}.get(url, url)
        r = of[i, "revisit" if later else "response", uri]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["refers_to"] == (top[html] if later else None) and r["payload"] == (None if later else data)
    by_id = {r["record_id"]: r for r in got}
    assert all(by_id[r["refers_to_id"]]["page_id"] == r["refers_to"] for r in got if r["record_type"] == "revisit")
    names = [gzip.decompress(r["content"])[:200] for r in warc._files(spark, arcs).collect()]
    assert len(names) > 1 and (version is None or all(f"\n{version} 0 ".encode() in n for n in names))


def test_other_content_becomes_a_resource():
    body = b"1.2.3.4 answer"
    head = b"2 0 me\n" + warc.FIELDS[2].encode() + b"\n"
    data = b"filedesc://x.arc 0.0.0.0 20200102030405 text/plain 200 - - 0 x.arc %d\n" % len(head) + head + b"\n"
    data += b"dns:host 1.2.3.4 20200102030405 text/dns 200 - - 9 x.arc %d\n" % len(body) + body + b"\n"
    first, second = warc.parse_arc(data)
    assert first["version"] == 2 and second["body"] == body and second["fields"]["URL"] == "dns:host"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-4]))
    made = b"".join(warc._warc_record("resource", {"WARC-Record-ID": "<x>"}, body))
    assert list(warc.parse_warc(made)) == [({"WARC-Type": "resource", "WARC-Record-ID": "<x>", "Content-Length": "14"}, body)]


def test_no_page_makes_no_archive(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    arcs, warcs = common.shared_folder(spark, "arc"), common.shared_folder(spark, "warc")
    warc.write_arc(empty, arcs)
    warc.convert(spark, arcs, warcs)
    assert warc.read_warc(spark, warcs).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    syllables = {"aa": "ta ke mi ro lu ve".split(), "bb": "sch ung ber zen oft rau".split()}
    rows, marks = [], []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(30, 60)))
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad else text, lang, f"s{i % 4}", len(text)))
        marks.append((i, int(not bad), 0))
    rows += [(240 + j, rows[j][1], rows[j][2], "s1", 1) for j in range(1, 60, 7)] + [(300, None, "aa", "s1", 0), (301, "12 ?", None, None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-duplicates", "mix", "packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert name == "packing" or out.columns == docs.columns
        kept.append((name, docs, out))
        docs = out
    ids = {name: (sorted(r["doc_id"] for r in a.collect()), sorted(r["doc_id"] for r in b.collect())) for name, a, b in kept}
    assert set(ids["language"][0]) - set(ids["language"][1]) == {300, 301}
    bad = {i for i, t, *_ in rows if t and "$$$" in t}
    assert len(set(ids["quality"][1]) & bad) <= 2 and len(set(ids["quality"][0]) - set(ids["quality"][1]) - bad) <= 2
    want = classes([(r["doc_id"], r["text"]) for r in kept[2][1].collect()], 5, 80)
    assert ids["near-duplicates"][1] == sorted(k for k, (_, top) in want.items() if k == top)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3][1]).collect()}
    assert ids["mix"][1] == sorted(i for i, n in taken.items() for _ in range(n))
    total = sum(len(t) for t in tokens_of([r["text"] for r in kept[4][1].collect()]))
    assert kept[4][2].agg(F.sum("length")).first()[0] == total
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == total


def test_mix_splits_rows_that_nothing_tells_apart(spark, monkeypatch):
    rows = [(None, "one two", "s") for _ in range(3_000)] + [(7, "one two", "s")] * 2_000 + [(i, "a b c", "s") for i in range(100, 400)] + [(i, "x y", "t") for i in range(500, 600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCK", 256)
    largest = []
    real = mixing.stored

    def spy(df, name):
        out = real(df, name)
        if name == "flight-0":
            largest.append(out.groupBy("source", "block").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(mixing, "stored", spy)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows) and largest[0] < 2 * 256
    for source in "st":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 3


def test_pipeline_stages_of_repeated_and_missing_keys(spark):
    import corpus_pipeline

    rng = random.Random(21)
    made = [" ".join("".join(rng.choice("ta ke mi ro lu ve".split()) for _ in range(3)) for _ in range(40)) for _ in range(9)]
    keys = [5, 5, 5, None, None, None, 8, 9, 9]
    rows = [(k, t, "aa", "s", len(t), "extra") for k, t in zip(keys, made)]
    rows += [(None, made[3], "aa", "s", 1, "copy"), (5, made[0], "aa", "s", 1, "copy"), (11, made[6], "aa", "s", 1, "copy"), (12, "long " * 30_000, "aa", "s", 1, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __copy string")
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["text"][:40] for r in kept.collect()) == sorted([t[:40] for t in made] + [("long " * 30_000)[:40]])
    taken = corpus_pipeline.mixed(spark, common.stored(kept.filter("n_chars > 1 OR doc_id <> 12"), "kept"), "")
    assert taken.columns == docs.columns
    counts = {}
    for r in taken.collect():
        counts[r["text"]] = counts.get(r["text"], 0) + 1
    assert set(counts) <= set(made) | {"long " * 30_000} and max(counts.values()) == 1 and len(counts) == 9
    empty = docs.limit(0)
    assert corpus_pipeline.distinct(spark, empty, "").count() == corpus_pipeline.mixed(spark, empty, "").count() == 0
