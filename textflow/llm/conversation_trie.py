"""Prefix trie of conversations, by double-array tries over shards.

A conversation is the sequence of its turns' digests (128 bits of role and
text); no text travels further.  Sequences are range-partitioned in their
order, so equal ones meet (their ids are hashed as they stream past, none are
gathered) and those with a common beginning are neighbours.  A task cuts its
sorted sequences into shards of about SHARD_TURNS turns, numbers the turns of
a shard densely and packs its trie into BASE and CHECK arrays.

Only nodes on the paths of a shard's first and last sequence can stand in
another shard as well.  All other nodes are complete: their aggregates are
added up bottom-up along the arrays and written.  What complete children add
to an open node is kept with the open path, and the open paths of all shards
(two each) are the sequences of the next round, until one shard holds them all.
"""

from __future__ import annotations

from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm.double_array import DoubleArray
from textflow.llm.stored import bounded_batches, discard, pick, store
from textflow.operators.partitioned import checked_broadcast

#: Turns of a shard, about; sequences that a shard has at least; sequences that one shard may always hold.
SHARD_TURNS, SHARD_ROWS, LAST_ROWS = 1 << 15, 4, 8
#: Turns of a task, where there are more tasks than the session's partitions.
TASK_TURNS = 1 << 22
_BYTES = 16  # of a turn's digest

_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = {**{c: pa.int64() for c in _NODE}, "ends_sha256": pa.string(), "node": pa.binary(), "parent": pa.binary(),
           "seq": pa.binary(), "sizes": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "ends": pa.list_(pa.string()),
           **{c: pa.list_(pa.int64()) for c in ("n", "least", "children", "leaves", "saved")}}
_DDL = ", ".join([*[f"{c} long" for c in _NODE], "ends_sha256 string", "node binary", "parent binary", "seq binary", "sizes array<int>", "at array<int>",
                  "ends array<string>", *[f"{c} array<long>" for c in ("n", "least", "children", "leaves", "saved")]])
_NOTHING = sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq binary, sizes array<int>) of every conversation: the
    digests of its turns one after another, and the code points of their texts.

    Turns stand by turn number, null first, those of one number by digest.  A
    null role or text is empty.  Rows without a conversation id are no one's.
    One conversation's digests (not its texts) must fit a task."""
    own = pick(turns, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = own.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.length(text).alias("size")).alias("t"))
    return (one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("seq"), F.col("t.size").alias("sizes")))


def branched(own: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The sequences of the report: conversation c begins with the first h
    turns of conversation c - c % ``every`` (as many as it has), h = crc32(c) %
    ``heads``, and goes on with its own turns after the first h."""
    own = store(own, "sequences")
    most = heads - 1
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.substring("seq", 1, most * _BYTES).alias("head"),
                                                            F.slice("sizes", 1, most).alias("head_sizes"))
    h = "CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {} AS INT)".format(heads)
    joined = own.withColumn("donor", F.expr(f"conv_id - conv_id % {every}")).join(first, "donor", "left").withColumn("h", F.expr(h))
    return joined.select("conv_id", F.expr(f"concat(substring(coalesce(head, X''), 1, h * {_BYTES}), substring(seq, h * {_BYTES} + 1))").alias("seq"),
                         F.expr("concat(slice(coalesce(head_sizes, array()), 1, h), slice(sizes, h + 1, greatest(size(sizes) - h, 0)))").alias("sizes"))


class _Path:
    """A sequence and what is known at places along it: {depth: [n, least id, complete children, their leaves, their saved tokens, hash of the ends]}."""

    def __init__(self, seq: bytes, sizes: list[int], known: dict[int, list]):
        self.seq, self.sizes, self.known = seq, sizes, known


def _key(seq: bytes, depth: int) -> bytes:
    return md5(seq[:depth * _BYTES]).digest()


def _codes(paths: list[_Path]) -> list[list[int]]:
    """Dense ids of turns, numbered level by level so that siblings have near numbers."""
    cut = [[p.seq[i:i + _BYTES] for i in range(0, len(p.seq), _BYTES)] for p in paths]
    number: dict[bytes, int] = {}
    live, depth = cut, 0
    while live := [row for row in live if len(row) > depth]:
        for row in live:
            number.setdefault(row[depth], len(number))
        depth += 1
    return [[number[x] for x in row] for row in cut]


def _shard(paths: list[_Path], last: bool, first_round: bool) -> pa.RecordBatch:
    """Complete nodes and open paths of a shard; with ``last`` all nodes are complete."""
    rows = _codes(paths)
    trie = DoubleArray(rows)
    size = len(trie.check)
    n, least, children, leaves, saved, ends = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [None] * size
    whose, depth = [0] * size, [0] * size  # a path through the node, and its depth
    walks = [trie.walk(row) for row in rows]
    for i, (path, walk) in enumerate(zip(paths, walks)):
        for d, slot in enumerate(walk):
            whose[slot], depth[slot] = i, d
        for d, (k, low, c, v, t, sha) in path.known.items():
            slot = walk[d]
            n[slot] += k
            if low is not None:
                least[slot] = low if least[slot] is None else min(least[slot], low)
            children[slot], leaves[slot], saved[slot], ends[slot] = children[slot] + c, leaves[slot] + v, saved[slot] + t, sha or ends[slot]
    open_ = set() if last else {*walks[0], *walks[-1]}
    for slot in reversed(trie.order):
        if slot in open_:
            continue
        path, d = paths[whose[slot]], depth[slot]
        if not children[slot]:
            leaves[slot] = 1
        saved[slot] += (n[slot] - 1) * (path.sizes[d - 1] if d else 0)
        if d:
            up = trie.check[slot]
            n[up], children[up], leaves[up], saved[up] = n[up] + n[slot], children[up] + 1, leaves[up] + leaves[slot], saved[up] + saved[slot]
            least[up] = least[slot] if least[up] is None else min(least[up], least[slot])
    columns = {c: [] for c in _SCHEMA}

    def put(**values) -> None:
        for c, out in columns.items():
            out.append(values.get(c))

    for slot in trie.order:
        if slot not in open_:
            seq, d, up = paths[whose[slot]].seq, depth[slot], trie.check[slot]
            put(conv_id=least[slot], depth=d, n_convs=n[slot], n_children=children[slot], n_leaves=leaves[slot], saved_tokens=saved[slot],
                ends_sha256=ends[slot] or _NOTHING, node=None if first_round else _key(seq, d),
                parent_conv_id=least[up] if d and up not in open_ else None, parent=_key(seq, d - 1) if d and up in open_ else None)
    done: set[int] = set()
    for i in [] if last else dict.fromkeys((0, len(paths) - 1)):
        at = [d for d, slot in enumerate(walks[i]) if slot not in done and (n[slot] or children[slot] or ends[slot])]
        slots = [walks[i][d] for d in at]
        done.update(walks[i])
        put(seq=paths[i].seq, sizes=paths[i].sizes, at=at, ends=[ends[s] for s in slots], n=[n[s] for s in slots], least=[least[s] for s in slots],
            children=[children[s] for s in slots], leaves=[leaves[s] for s in slots], saved=[saved[s] for s in slots])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in _SCHEMA.items()], list(_SCHEMA))


def _distinct(batches):
    """Paths of sorted (seq, sizes, conv_id): one for each sequence, its ids counted and hashed in their order."""
    seq, sizes, n, least, sha = None, None, 0, None, None
    for batch in batches:
        for s, z, conv in zip(batch["seq"].to_pylist(), batch["sizes"].to_pylist(), batch["conv_id"].to_pylist()):
            if s != seq:
                if seq is not None:
                    yield _Path(seq, sizes, {len(sizes): [n, least, 0, 0, 0, sha.hexdigest()]})
                seq, sizes, n, least, sha = s, z, 0, conv, sha256()
            sha.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
    if seq is not None:
        yield _Path(seq, sizes, {len(sizes): [n, least, 0, 0, 0, sha.hexdigest()]})


def _opened(batches):
    """Paths that an earlier round left open."""
    for batch in batches:
        for r in batch.to_pylist():
            yield _Path(r["seq"], r["sizes"], {d: list(x) for d, *x in zip(r["at"], r["n"], r["least"], r["children"], r["leaves"], r["saved"], r["ends"])})


def _round(rows: DataFrame, first_round: bool) -> tuple[DataFrame, bool]:
    """Shards of all paths; whether one held them all."""
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sizes")).alias("turns")).first()
    turns, n = said.turns or 0, said.n
    last = turns <= SHARD_TURNS or n <= LAST_ROWS
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // TASK_TURNS))
    tasks = 1 if last else max(2, min(n // LAST_ROWS, -(-turns // SHARD_TURNS), tasks))
    limit, least = SHARD_TURNS, SHARD_ROWS

    def run(batches):
        held, size = [], 0
        for path in (_distinct if first_round else _opened)(batches):
            held.append(path)
            size += len(path.sizes)
            if not last and size >= limit and len(held) >= least:
                yield _shard(held, False, first_round)
                held, size = [], 0
        if held:
            yield _shard(held, last, first_round)

    order = ["seq", "conv_id"] if first_round else ["seq"]
    dealt = rows.repartition(1) if last else rows.repartitionByRange(tasks, "seq")
    return store(dealt.sortWithinPartitions(*order).mapInArrow(run, _DDL), "trie"), last


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, seq, sizes), as :func:`sequences` returns them.

    A node is a distinct sequence of first d turns.  Returns per node
    (conv_id, its smallest member; depth; parent_conv_id; n_convs; n_children;
    n_leaves, childless nodes of its subtree; saved_tokens, over its subtree
    the members but one times the code points of the last text; ends_sha256 of
    the ascending ids, joined by commas, that end there).  A conversation
    without turns is a member of the root alone; no conversations, no nodes.
    A repeated id is a member each time it occurs.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows, first_round, nodes = store(conversations.select("conv_id", "seq", "sizes"), "paths"), True, []
    while True:
        found, last = _round(rows, first_round)
        nodes.append(found.where("conv_id is not null").select(*_NODE, "ends_sha256", "node", "parent"))
        if first_round:
            discard(rows)
        if last:
            break
        rows, first_round = found.where("conv_id is null").select("seq", "sizes", "at", "ends", "n", "least", "children", "leaves", "saved"), False
    every = nodes[0]
    for more in nodes[1:]:
        every = every.union(more)
    result = [*_NODE, "ends_sha256"]
    if len(nodes) == 1:
        return every.select(result)
    known = every.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    under = every.where("parent is not null").drop("parent_conv_id").join(checked_broadcast(known, 100_000), "parent").withColumnRenamed("up", "parent_conv_id")
    return every.where("parent is null").select(result).union(under.select(result))


def report(conversations: DataFrame) -> DataFrame:
    """Nodes of the branched conversations of a table (conv_id, turn, role, text)."""
    return prefix_nodes(branched(sequences(conversations)))


def report_sql() -> str:
    """DuckDB SQL for :func:`report`.  crc32 is computed digit by digit from its table of 256."""
    return """
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256))::BIGINT AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
               length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
    SELECT conv_id, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM own)
    UNION ALL SELECT x.conv_id, x.k + 1, xor(x.c >> 8, b.c) FROM crc x JOIN bits b
    ON b.k = 8 AND b.i = xor(x.c & 255, ascii(substr(x.conv_id::VARCHAR, x.k + 1, 1))) WHERE x.k < length(x.conv_id::VARCHAR)),
conv AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = length(conv_id::VARCHAR)),
rebuilt AS (SELECT c.conv_id, 0 AS part, d.pos, d.size, d.digest FROM conv c JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 100 AND d.pos <= c.h
            UNION ALL SELECT c.conv_id, 1, o.pos, o.size, o.digest FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
placed AS (SELECT conv_id, size, digest, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
prefix AS (SELECT conv_id, depth, size, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
           UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
whole AS (SELECT conv_id, max(depth) AS turns FROM prefix GROUP BY conv_id),
node AS (SELECT node, min(p.conv_id) AS conv_id, min(depth) AS depth, any_value(size) AS size, count(*) AS n_convs,
                sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
         FROM prefix p JOIN whole w ON w.conv_id = p.conv_id GROUP BY node),
above AS (SELECT n.node, p.node AS parent FROM node n JOIN prefix p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
child AS (SELECT parent, count(*) AS n FROM above GROUP BY parent),
below AS (SELECT p.node AS top, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
          FROM node n JOIN prefix p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN child c ON c.parent = n.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.top = n.node LEFT JOIN child c ON c.parent = n.node
LEFT JOIN above a ON a.node = n.node LEFT JOIN node u ON u.node = a.parent
"""
