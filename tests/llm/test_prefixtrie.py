"""The prefix trie against a plain one, with small shards, long and turnless conversations."""

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from tallyveil.llm import prefixtrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow_trie(rebuilt):
    """Rows of COLUMNS from {conv_id: [(role, text)]}."""
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), up, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def slow_turns(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def slow_regrown(turns):
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return made


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in [*range(0, 260), 1007, 5 * 10**9 + 1, 5 * 10**9 + 2]:
        # A third share their first turn, some are copies, one is long, ids of a family may be absent.
        if c % 5 == 0 and rng.random() < 0.3:
            continue
        n = rng.choice((1, 2, 3, 6)) if c != 77 else 400
        for t in range(n):
            text = "common" if t == 0 and rng.random() < 0.4 else rng.choice(("ä", "yes", "no", "")) if n < 400 else f"t{t}"
            out.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "bot", None)) if t else "user", text))
            if out[-1][1] is None and any(r[0] == c and r[1] is None for r in out[:-1]):
                out[-1] = (c, t, *out[-1][2:])
    out += [(3, 50, "user", "same"), (3, 50, "user", "same"), (8, 60, "bot", None), (8, 61, None, "ü" * 40_000)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, mark string, size int")


def got(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()}


def test_regrown_trie_equals_plain(spark, rows):
    numbered = prefixtrie.numbered_turns(table(spark, rows))
    found = prefixtrie.prefix_trie(prefixtrie.regrown(numbered))
    expected = slow_trie(slow_regrown(slow_turns(rows)))
    assert found.count() == len(expected) and got(found) == expected


def test_cuts_change_nothing(rows, monkeypatch):
    """Small shards, and conversations that run through alone, give the same sums, members and end lists."""
    made = slow_regrown(slow_turns(rows))
    lines = []
    for c in sorted(made):
        lines.append((c, -1, None, 0))
        lines += [(c, i, hashlib.md5(repr(t).encode()).digest(), len(t[1].encode())) for i, t in enumerate(made[c])]
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("mark", pa.binary()), ("size", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*lines[i : i + 17]), schema)], schema=schema) for i in range(0, len(lines), 17)]

    def summed():
        total = {}
        for batch in prefixtrie._shards(batches):
            for r in batch.to_pylist():
                held = total.setdefault((r["node"], r["k1"], r["k2"], r["depth"]), [0, 0, set(), []])
                held[0] += r["n"]
                held[1] += r["ends"]
                if not r["node"]:
                    held[2].add(r["first"])
                if r["piece"]:
                    held[3].append(r["piece"])
        return {k: (v[0], v[1], frozenset(v[2]), ",".join(v[3])) for k, v in total.items()}

    whole = summed()
    for shard, turns in ((7, 5), (3, 65_536), (1024, 40)):
        monkeypatch.setattr(prefixtrie, "SHARD", shard)
        monkeypatch.setattr(prefixtrie, "TURNS", turns)
        assert summed() == whole


def test_plain_trie_without_families(spark, rows):
    numbered = prefixtrie.numbered_turns(table(spark, rows))
    found = prefixtrie.prefix_trie(prefixtrie.with_roots(numbered, numbered.select("conv_id").distinct()))
    assert got(found) == slow_trie(slow_turns(rows))


def test_odd_tables(spark):
    empty = table(spark, [(1, 1, "a", "b")]).limit(0)
    assert prefixtrie.prefix_trie(prefixtrie.regrown(prefixtrie.numbered_turns(empty))).count() == 0
    lone = table(spark, [(None, 1, "a", "b"), (4, None, None, None)])
    found = prefixtrie.prefix_trie(prefixtrie.regrown(prefixtrie.numbered_turns(lone)))
    assert got(found) == slow_trie(slow_regrown({4: [("", "")]}))


def test_sql_says_the_same(rows):
    # Of turns of one number the SQL orders by digest, the plain rule by role only; such rows are equal here.
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixtrie.OP11_SQL})")
    assert set(cursor.fetchall()) == slow_trie(slow_regrown(slow_turns(rows)))
