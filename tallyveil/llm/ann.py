"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard, and beam search.

Equal vectors are one node; of its keys only the ``k + 1`` smallest can be among a query's ``k`` nearest, so no more
travel (Spark limits them before the shuffle). Nodes are dealt to shards of bounded size, each of vectors of about one
length (a power of two). Within a shard, vectors are scaled and get one more component that makes all of them equally
long, so that the largest inner product is the smallest distance.

Build: nodes enter in batches that grow with the graph. A greedy search in the graph so far proposes each node's
neighbours; relaxed distance pruning keeps a candidate unless a kept one is ``ALPHA`` times nearer to it than the node
is; kept edges are also added backwards, and lists that grow too long are pruned again. Every node is indexed. The graph
is a table of nodes with their edges in the shared folder.

Search: each block of queries runs a beam search through each shard. Its whole beam is scored again on the original
vectors in double precision, and the shards' best rows merge per query.

Results: vectors that are null, empty, zero or hold null or non-finite components, and null keys, take no part. A query
meets only vectors of its own length. Rows that repeat a key with one vector are one candidate, a query is the largest
vector of its key by array order. Equal scores go to the smaller key. An empty table gives no rows; a shard with no more
nodes than the beam is searched as a whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveil.llm.common import stored
from tallyveil.llm.topk import blocked, matrix, usable

#: Nodes of a shard and queries of a block, on average.
SHARD = 16_384
QUERIES = 16_384
#: Edges that pruning keeps, and edges a list may hold before it is pruned again.
KEPT, FULL = 24, 40
ALPHA = 1.2
#: Width of the beam while building and while searching, and nodes it expands in one step.
BUILD_BEAM, BEAM, STEP = 64, 128, 4
ENTRIES = 16
LOCKSTEP = 512


def beam_search(data: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """The nodes of largest inner product that a beam finds for each query, largest first, -1 where it found fewer.

    The nodes are equally long, so these are the nearest. All queries take their steps together.
    """
    n = len(queries)
    lines = np.arange(n)[:, None]
    seen = np.zeros((n, len(data)), bool)
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    first = entries[: min(len(entries), width)]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = -(queries @ data[first].T)
    done[:, : len(first)] = False
    seen[:, first] = True
    active = np.arange(n)
    while len(active):
        near = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(near, min(STEP, width) - 1, axis=1)[:, :STEP]
        real = np.isfinite(np.take_along_axis(near, pick, axis=1))
        alive = real.any(axis=1)
        active, pick, real = active[alive], pick[alive], real[alive]
        if not len(active):
            break
        at = active[:, None]
        chosen = np.where(real, ids[at, pick], -1)
        done[at, pick] |= real
        follow = np.where((chosen >= 0)[:, :, None], edges[chosen], -1).reshape(len(active), -1)
        follow.sort(axis=1)
        new = follow >= 0
        new[:, 1:] &= follow[:, 1:] != follow[:, :-1]
        new &= ~seen[at, follow]
        row, col = np.nonzero(new)
        if not len(row):
            continue
        node = follow[row, col]
        seen[active[row], node] = True
        # New nodes move to the front of their rows, so that the merge is no wider than it must be.
        count = new.sum(axis=1)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((len(active), int(count.max())), -1, np.int64)
        far = np.full(more.shape, np.inf, np.float32)
        more[row, place] = node
        far[row, place] = -np.einsum("ij,ij->i", data[node], queries[active[row]])
        all_ids = np.concatenate([ids[active], more], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_done = np.concatenate([done[active], more < 0], axis=1)
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        dist[active] = np.take_along_axis(all_dist, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.where(np.isfinite(dist[lines, order]), ids[lines, order], -1)


def robust_prune(data: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to KEPT diverse edges of each node out of its candidates (-1: none), nearest first."""
    own = candidates == nodes[:, None]
    vectors = data[candidates]
    to_node = ((vectors - data[nodes][:, None, :]) ** 2).sum(axis=2)
    to_node[own | (candidates < 0)] = np.inf
    order = np.argsort(to_node, axis=1, kind="stable")
    candidates, to_node = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(to_node, order, axis=1)
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    length = (vectors * vectors).sum(axis=2)
    between = length[:, :, None] + length[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    out = np.full((len(nodes), FULL), -1, np.int64)
    open_ = np.isfinite(to_node)
    open_[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    lines = np.arange(len(nodes))
    for kept in range(KEPT):
        some = open_.any(axis=1)
        if not some.any():
            break
        first = open_.argmax(axis=1)
        out[some, kept] = candidates[some, first[some]]
        near = ALPHA * ALPHA * between[lines, first] <= to_node
        open_ &= ~(near & some[:, None])
        open_[lines, first] = False
    return out


def build(vectors: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node by FULL, -1 for none) and entry nodes of a graph over equally long vectors."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    middle = ((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin()
    order = np.concatenate([[middle], order[order != middle]])
    edges = np.full((n, FULL), -1, np.int64)
    entries = order[: min(n, ENTRIES)]
    for node in entries:  # the entries know each other
        others = entries[entries != node]
        edges[node, : len(others)] = others
    at = len(entries)
    while at < n:
        batch = order[at : at + min(LOCKSTEP, max(16, at // 4))]
        at += len(batch)
        found = beam_search(vectors, edges, entries, vectors[batch], min(BUILD_BEAM, at))
        edges[batch] = robust_prune(vectors, batch, found)
        source, place = np.nonzero(edges[batch] >= 0)
        target = edges[batch][source, place]
        source = batch[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (edges[nodes] >= 0).sum(axis=1)
        fits = held + count <= FULL
        rank = np.arange(len(target)) - np.repeat(first, count)
        short = np.repeat(fits, count)
        edges[target[short], (np.repeat(held, count) + rank)[short]] = source[short]
        # Lists that would overflow are pruned, shorter ones together with others of like length.
        long_ = np.flatnonzero(~fits)
        for group in np.split(long_[np.argsort(count[long_], kind="stable")], range(128, len(long_), 128)) if len(long_) else []:
            wide = int(count[group].max())
            more = np.full((len(group), wide), -1, np.int64)
            for i, g in enumerate(group):
                more[i, : count[g]] = source[first[g] : first[g] + count[g]]
            edges[nodes[group]] = robust_prune(vectors, nodes[group], np.concatenate([edges[nodes[group]], more], axis=1))
    return edges, entries


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors of length 1, whatever the size of their components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors, all scaled alike, with one more component that makes all as long as the longest.

    The vectors of a shard differ in length by a factor of 2 or so, so single precision is enough for the beam.
    """
    vectors = vectors / np.abs(vectors).max()
    square = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


_INDEX = "dim int, s int, node int, v array<double>, ids array<long>, edges array<int>, entry boolean"


def _build_shard(table: pa.Table) -> pa.Table:
    n = table.num_rows
    edges, entries = build(lengthened(matrix(table.column("v"))))
    entry = np.zeros(n, bool)
    entry[entries] = True
    kept = edges >= 0
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)), pa.array(edges[kept].astype(np.int32)))
    return pa.Table.from_arrays([table.column("dim"), table.column("s"), pa.array(np.arange(n, dtype=np.int32)), table.column("v"), table.column("ids"), lists, pa.array(entry)], names=["dim", "s", "node", "v", "ids", "edges", "entry"])


def index(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", copies: int = 21) -> DataFrame:
    """The graph: a row per distinct vector with its shard, its ``copies`` smallest keys and its edges."""
    rows = vectors.filter(usable(F.col(embedding)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.exists("v", lambda x: x != 0)).dropDuplicates()
    order = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= copies)
    nodes = stored(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "nodes")
    # A shard holds vectors of one length class, so none drowns in the rounding of another; doubles have some 2,000 classes.
    largest = F.array_max(F.transform("v", F.abs))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + (x / F.col("largest")) * (x / F.col("largest")))
    length = F.floor(F.log2("largest") + F.log2(F.sqrt(square))).cast("int")
    classed = nodes.withColumn("largest", largest).withColumn("class", length).drop("largest")
    first, shards = {}, 0
    for r in sorted(classed.groupBy("class").count().collect(), key=lambda r: r["class"]):
        n = -(-r["count"] // SHARD)
        first[r["class"]] = (shards, n)
        shards += n
    own = F.create_map(*[F.lit(x) for name, (at, n) in first.items() for x in (name, F.array(F.lit(at), F.lit(n)))])[F.col("class")] if first else F.array(F.lit(0), F.lit(1))
    dealt = classed.withColumn("s", (own[0] + F.pmod(F.monotonically_increasing_id(), own[1])).cast("int"))
    return stored(dealt.select("dim", "s", "v", "ids").groupBy("dim", "s").applyInArrow(_build_shard, _INDEX), "index")


def _search_unit(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        if not nodes.num_rows or not queries.num_rows:
            return schema.empty_table()
        nodes = nodes.sort_by("node")
        vectors, q = matrix(nodes.column("v")), matrix(queries.column("v"))
        lists = nodes.column("edges").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        edges = np.full((len(vectors), FULL), -1, np.int64)
        edges[np.repeat(np.arange(len(vectors)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        entries = np.flatnonzero(nodes.column("entry").to_numpy())
        ids = nodes.column("ids").combine_chunks()
        owned, starts = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        asked = queries.column("id").to_numpy()
        data = lengthened(vectors)
        out: list[tuple] = []
        for at in range(0, len(q), LOCKSTEP):
            part = q[at : at + LOCKSTEP]
            if len(vectors) <= BEAM:
                found = np.tile(np.arange(len(vectors)), (len(part), 1))
            else:
                flat = np.concatenate([unit(part), np.zeros((len(part), 1))], axis=1).astype(np.float32)
                found = beam_search(data, edges, entries, flat, BEAM)
                # A beam that ran dry is no reason for a short list: such a query meets the whole shard.
                dry = (found >= 0).sum(axis=1) <= k
                found = [np.arange(len(vectors)) if d else near for d, near in zip(dry, found)]
            for i, near in enumerate(found):
                near = near[near >= 0]
                score = vectors[near] @ part[i]
                count = starts[near + 1] - starts[near]
                spots = np.arange(count.sum()) + np.repeat(starts[near] - np.cumsum(count) + count, count)
                keys, scores = owned[spots], np.repeat(score, count)
                other = keys != asked[at + i]
                keys, scores = keys[other], scores[other]
                best = np.lexsort((keys, -scores))[:k]
                out.append((np.full(len(best), asked[at + i]), keys[best], scores[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], schema=schema)

    return run


def search(graph: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, without the rows of its own key."""
    rows = queries.filter(usable(F.col(embedding)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    shards = (graph.agg(F.max("s")).first()[0] or 0) + 1
    blocks = max(1, -(-rows.count() // QUERIES))
    left = graph.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = blocked(rows, F.xxhash64("id"), "q", blocks, "s", shards)
    found = left.groupBy("dim", "s", "q").cogroup(right.groupBy("dim", "s", "q")).applyInArrow(_search_unit(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asked: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 20) -> DataFrame:
    """Index all rows and search for those for which ``asked`` holds."""
    return search(index(vectors, key, embedding, k + 1), vectors.filter(asked), key, embedding, k)


def op3(spark, sf_dir):
    """The twenty nearest found of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
