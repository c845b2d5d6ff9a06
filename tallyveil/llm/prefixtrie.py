"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are dealt to tasks by ranges of their id and cut into shards of up to ``SHARD`` conversations or ``TURNS``
turns. A shard's index is vertical: for each (position, turn) the set of conversations with that turn there, as bits. A
depth-first search intersects a node's bits with the postings of the next position: each intersection is a child, its
popcount the child's members. The members that end at a node make its end list. A lone member's turns follow without
intersections, and a conversation of over ``TURNS`` turns runs through alone, turn by turn.

Spark adds up the shards' nodes by a 128-bit digest of the path, so a node that a third of all conversations share
meets as one row of each shard. What a subtree holds needs no walk by levels: of the nodes on a conversation's path, it is
the smallest member of those from some depth down. Each such node's share is written to that conversation, summed from
the end, and added up over the members of every node above it. End lists lie in ranges of ids, so a node's pieces, sorted,
run through one SHA-256 and are never held together.

Order of turns: by number, null first; equal numbers by role and then by the SHA-256 of role and text. Null role or text
counts as empty. A null conversation id names no conversation; its rows take no part. Repeated rows are turns of their
own. Other columns do not matter. An empty table gives no rows, not even a root. A conversation's turns are numbered and
summed in order, thus in one task, which spills and holds no conversation whole.
"""

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyveil.llm.common import stored

#: Conversations and turns of a shard at most.
SHARD = 1_024
TURNS = 65_536
#: Rows that a task hands over at once.
ROWS = 16_384

_ROOT = b"\0" * 16
_PARTS = "node boolean, k1 long, k2 long, p1 long, p2 long, depth long, n long, first long, ends long, size long, piece string"
_NAMES = [part.split()[0] for part in _PARTS.split(", ")]
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
_ARROW = pa.schema([(part.split()[0], _TYPES[part.split()[1]]) for part in _PARTS.split(", ")])


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, mark, size): every turn's place from 0, the digest of its role and text, the bytes of its text."""
    own, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    both = F.sha2(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own, said), 256)
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), own.alias("__role"),
        F.unhex(F.substring(both, 1, 32)).alias("mark"), F.octet_length(said).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("__turn").asc_nulls_first(), "__role", "mark")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "mark", "size")


def with_roots(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns and, for every id, a row at place -1, by which also a conversation without turns is seen."""
    none = F.lit(None).cast("binary")
    return turns.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), none.alias("mark"), F.lit(0).cast("long").alias("size")))


def regrown(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin as the first of their family does.

    Conversation c gets the first h turns of conversation c - c % family, then its own turns after its first h;
    h is the crc32 of the decimal c modulo ``heads``. A family is a few ids, and h is below ``heads``, so little is copied.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.select("conv_id").distinct()
    base = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    led = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    copied = led.join(base, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "mark", "size")
    return with_roots(copied.unionByName(turns.filter(F.col("pos") >= h)), ids)


def _child(key: bytes, mark: bytes) -> bytes:
    return hashlib.blake2b(key + mark, digest_size=16).digest()


def _bits(members: int):
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


class _Rows:
    """Rows gathered into record batches."""

    def __init__(self):
        self.rows = []

    def node(self, key, parent, depth, n, first, ends, size, piece):
        self.rows.append((True, *struct.unpack("<qq", key), *struct.unpack("<qq", parent), depth, n, first, ends, size, piece))

    def member(self, key, depth, conv):
        self.rows.append((False, *struct.unpack("<qq", key), 0, 0, depth, 0, conv, 0, 0, None))

    def batch(self):
        columns = zip(*self.rows) if self.rows else [()] * len(_NAMES)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        self.rows = []
        return made


def shard_nodes(convs: list[tuple[int, list[tuple[bytes, int]]]], out: _Rows):
    """Nodes of a shard and the members of each, from conversations (id, [(mark, size)]) in the order of their ids."""
    postings: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for i, (_, turns) in enumerate(convs):
        bit = 1 << i
        ended[len(turns)] = ended.get(len(turns), 0) | bit
        for place in enumerate(mark for mark, _ in turns):
            postings[place] = postings.get(place, 0) | bit
    stack = [((1 << len(convs)) - 1, 0, _ROOT, _ROOT, 0)]
    while stack:
        members, depth, key, parent, size = stack.pop()
        ends = members & ended.get(depth, 0)
        piece = ",".join(str(convs[i][0]) for i in _bits(ends)) or None
        first = convs[(members & -members).bit_length() - 1][0]
        out.node(key, parent, depth, members.bit_count(), first, ends.bit_count(), size, piece)
        for i in _bits(members):
            out.member(key, depth, convs[i][0])
        if len(out.rows) >= ROWS:
            yield out.batch()
        rest = members & ~ends
        while rest:
            mark, size = convs[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth, mark] if rest & (rest - 1) else rest
            rest ^= child
            stack.append((child, depth + 1, _child(key, mark), key, size))


def _shards(batches):
    """Rows of sorted conversations in, nodes and members out."""
    out, convs, turns = _Rows(), [], 0
    # The key so far and the depth of a conversation that runs through alone.
    alone = None

    def closed():
        if alone:
            key, parent, depth, size = alone
            out.node(key, parent, depth, 0, convs[-1][0], 1, size, str(convs[-1][0]))

    def passed(mark, size):
        key, _, depth, _ = alone
        now = (_child(key, mark), key, depth + 1, size)
        out.node(now[0], key, depth + 1, 1, convs[-1][0], 0, size, None)
        out.member(now[0], depth + 1, convs[-1][0])
        return now

    for batch in batches:
        for conv, pos, mark, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "mark", "size"))):
            if pos < 0:
                closed()
                if alone or len(convs) >= SHARD or turns >= TURNS:
                    if not alone:
                        yield from shard_nodes(convs, out)
                    convs, turns, alone = [], 0, None
                convs.append((conv, []))
            elif alone:
                alone = passed(mark, size)
                if len(out.rows) >= ROWS:
                    yield out.batch()
            else:
                held = convs[-1][1]
                held.append((mark, size))
                turns += 1
                if len(held) > TURNS:
                    if convs[:-1]:
                        yield from shard_nodes(convs[:-1], out)
                    convs, alone = [(conv, [])], (_ROOT, _ROOT, 0, 0)
                    out.node(_ROOT, _ROOT, 0, 1, conv, 0, 0, None)
                    out.member(_ROOT, 0, conv)
                    for at in held:
                        alone = passed(*at)
                    yield out.batch()
    closed()
    if convs and not alone:
        yield from shard_nodes(convs, out)
    yield out.batch()


def _digests(batches):
    """SHA-256 of each node's pieces, joined by commas; pieces come sorted by node and then by id."""
    node, running = None, None
    for batch in batches:
        done = []
        for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "piece"))):
            if (k1, k2) == node:
                running.update(b"," + piece.encode())
                continue
            if node:
                done.append((*node, running.hexdigest()))
            node, running = (k1, k2), hashlib.sha256(piece.encode())
        yield _digest_batch(done)
    if node:
        yield _digest_batch([(*node, running.hexdigest())])


def _digest_batch(rows):
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["k1", "k2", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes (k1, k2, depth, conv_id, parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` (conv_id, pos, mark, size) with a row at place -1 for every conversation, as from ``with_roots``. A node
    is named by its path's digest (k1, k2); saved_tokens counts bytes of turns that sharing saves below a node and at it.
    """
    ranged = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    parts = stored(ranged.mapInArrow(_shards, _PARTS), "trie-parts")
    summed = parts.filter("node").groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.min("first").alias("conv_id"), F.sum("ends").alias("n_ends"), F.max("size").alias("size"),
    )
    nodes = stored(summed, "trie-nodes")
    # What a node adds to the subtrees it lies in, at the place of its smallest member.
    shares = nodes.select(
        F.col("conv_id").alias("first"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"), F.lit(1).cast("long").alias("own"),
    )
    members = parts.filter("NOT node").select("k1", "k2", "first", "depth").join(shares, ["first", "depth"], "left").fillna(0, ["saved", "leaf", "own"])
    upward = Window.partitionBy("first").orderBy(F.col("depth").desc())
    below = members.select(
        "k1", "k2", F.sum("saved").over(upward).alias("saved"), F.max("leaf").over(upward).alias("leaf"),
        F.lag("own", 1, 0).over(upward).alias("child"),
    )
    held = below.groupBy("k1", "k2").agg(F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    pieces = parts.filter("node AND piece IS NOT NULL").select("k1", "k2", "first", "piece")
    pieces = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    digests = pieces.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    # Most nodes lie below the second turn; the root, which is the parent of very many, is known without a join.
    root = nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    shallow = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    known = shallow.unionByName(nodes.filter("depth > 1").join(parents, ["p1", "p2"]).select(*nodes.columns, "parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    out = known.join(held, ["k1", "k2"]).join(digests, ["k1", "k2"], "left").fillna(empty, ["ends_sha256"])
    return out.select("k1", "k2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt within their families by the contract's rule."""
    turns = stored(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(regrown(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = """
WITH RECURSIVE said AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''),
        sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bits AS (
    SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS line FROM said
), cut AS (
    SELECT conv_id, (xor(list_reduce(line, lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 9)::INTEGER AS h
    FROM bits
), rebuilt AS (
    SELECT s.conv_id AS c, list_concat(coalesce(b.turns, [])[1:h], s.turns[h + 1:]) AS turns
    FROM said s JOIN cut USING (conv_id) LEFT JOIN said b ON b.conv_id = s.conv_id - s.conv_id % 5
), paths AS (
    SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns FROM rebuilt
), nodes AS (
    SELECT d, turns[1:d] AS p, min(c) AS conv_id, count(*) AS n, list(c ORDER BY c) FILTER (len(turns) = d) AS ends
    FROM paths GROUP BY ALL
), lined AS (
    SELECT *, p[1:d - 1] AS up, CASE WHEN d > 0 THEN (n - 1) * strlen(p[d].t) ELSE 0 END AS saved, n = len(coalesce(ends, [])) AS leaf FROM nodes
), above AS (
    SELECT unnest(range(0, d + 1)) AS level, p, saved, leaf FROM lined
), held AS (
    SELECT p[1:level] AS p, sum(saved) AS saved_tokens, sum(leaf::INTEGER) AS n_leaves FROM above GROUP BY ALL
), kids AS (
    SELECT up AS p, count(*) AS n_children FROM lined WHERE d > 0 GROUP BY up
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(v.ends, ','), '')) AS ends_sha256
FROM lined v JOIN held h ON h.p = v.p LEFT JOIN kids k ON k.p = v.p LEFT JOIN nodes u ON v.d > 0 AND u.p = v.up
"""
