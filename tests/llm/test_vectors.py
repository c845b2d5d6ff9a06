"""Both vector searches against brute force, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in zip(ids, vectors)], SCHEMA)


def brute(rows, k, asked, code):
    """(query, rank, vec_id, score) by comparing each query with every row of another key."""
    good = [(i, [code(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries: dict = {}
    for i, v in good:
        if asked(i):
            queries[i] = max(queries.get(i, v), v)
    out = set()
    for q, u in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q and len(v) == len(u))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    return (centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 24)) * 0.6).astype(np.float32)


@pytest.mark.parametrize("candidates, queries", [(8_192, 2_048), (100, 7)])
def test_top_k_equals_brute_force(spark, vectors, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    got = topk.top_k(table(spark, vectors), F.col("vec_id") % 50 == 0).collect()
    want = brute(list(enumerate(vectors.tolist())), 5, lambda i: i % 50 == 0, lambda x: int(np.floor(256 * x)))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (1, [1, 2]), (1, [1, 2]), (50, [3, -1]), (50, [2, 2]), (3, None), (4, []), (5, [1, None]), (6, [nan, 1]), (7, [1, inf]), (100, [1, 2, 3]), (None, [9, 9]), (8, [0, 0])]
    got = topk.top_k(table(spark, [v for _, v in rows], [i for i, _ in rows]), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, 5, lambda i: i % 50 == 0, lambda x: int(np.floor(256 * x)))
    # A repeated row takes two ranks with the same key.
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_double_precision(spark):
    rows = [(0, [1e10, 3.0]), (1, [1e10, 5.0]), (2, [1e10, 7.0]), (3, [3e30, 1.0])]
    got = {(r["vec_id"], r["score"]) for r in topk.top_k(table(spark, [v for _, v in rows], range(4)), F.col("vec_id") == 0).collect()}
    exact = {i: sum(int(np.floor(256 * float(np.float32(a)))) * int(np.floor(256 * float(np.float32(b)))) for a, b in zip(rows[0][1], v)) for i, v in rows[1:]}
    assert got == {(i, min(s, (1 << 63) - 1)) for i, s in exact.items()}


@pytest.mark.parametrize("shard, queries", [(16_384, 2_048), (250, 11)])
def test_graph_search_finds_nine_tenths(spark, vectors, monkeypatch, shard, queries):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERIES", queries)
    monkeypatch.setattr(ann, "BEAM", 64)
    rows = ann.nearest(table(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    want = brute(list(enumerate(vectors.tolist())), 20, lambda i: i % 20 == 0, float)
    near = {(q, i) for q, _, i, _ in want}
    got = {(r["query_id"], r["vec_id"]) for r in rows}
    assert len(rows) == len(want) and len(got & near) >= 0.9 * len(near)
    for r in rows:
        exact = float(np.dot(vectors[r["query_id"]].astype(float), vectors[r["vec_id"]].astype(float)))
        assert abs(r["score"] - exact) < 1e-12
    ranks: dict = {}
    for r in rows:
        ranks.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all(sorted(x) == sorted(x, key=lambda y: (y[1], y[2])) and len(x) == 20 for x in ranks.values())


def test_every_row_is_in_the_graph(spark, vectors):
    copies = np.concatenate([vectors[:100], np.repeat(vectors[:1], 60, axis=0)])
    graph = ann.index(table(spark, copies))
    assert graph.count() == 100 and graph.filter(F.size("edges") == 0).count() == 0
    assert graph.agg(F.max(F.size("ids"))).first()[0] == 21


def test_graph_search_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1, 0]), (20, [0, 1]), (1, [1, 1]), (2, [1, 1]), (3, None), (4, []), (5, [1, None]), (6, [nan, 1]), (7, [0, 0]), (40, [1, 2, 3]), (None, [1, 1])]
    rows += [(60, [2, 1])] + [(100 + i, [3, 3]) for i in range(1, 20)]
    got = ann.nearest(table(spark, [v for _, v in rows], [i for i, _ in rows]), F.col("vec_id") % 20 == 0).collect()
    want = brute([r for r in rows if r[1] and any(x != 0 for x in r[1])], 20, lambda i: i % 20 == 0, float)
    assert {tuple(r) for r in got} == want
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("longer", [1.0, 1e5, 1e20])
def test_one_long_vector_drowns_no_other(spark, longer):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(1_500, 16)).astype(np.float32)
    data[700] *= np.float32(longer)
    got = ann.nearest(table(spark, data), F.col("vec_id") % 20 == 0).collect()
    want = brute(list(enumerate(data.tolist())), 20, lambda i: i % 20 == 0, float)
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.97 * len(want)


def test_lists_are_full_where_a_beam_runs_dry():
    data = np.eye(300, dtype=np.float32)
    edges = np.full((300, ann.FULL), -1, np.int64)
    assert (ann.beam_search(ann.lengthened(data), edges, np.arange(3), ann.lengthened(data)[:2], 8) >= 0).sum() == 6
