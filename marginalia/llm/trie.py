"""A prefix trie of conversations: nodes by block digests first, turns only where blocks diverge, subtree sums by doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_parquet
from .mixing import WORD
from .manifest import CRC32
from .order import numbered

#: Turns of a block.
BLOCK = 4
#: Blocks of a chunk, within which digests are summed up before chunks are.
CHUNK = 1024
#: Fixed values of the rebuilding: conversations share the opening of the one whose id is a multiple of SHARED, up to OPENING - 1 turns.
SHARED, OPENING = 20, 4
#: Bytes of ids that are joined to one row before they are hashed.
IDS_BYTES = 1 << 16
LANES = 4
EMPTY = hashlib.sha256(b"").hexdigest()


def _each(form: str, join: str = ", ") -> str:
    return join.join(form.format(i) for i in range(LANES))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, size, digest, words) for each turn, `at` from 0 by turn (null first; ties by role, then by the text's digest).

    Null roles and texts are empty; rows without conv_id take no part. Texts are digested where they lie and go no further.
    """
    role, text = (f"coalesce({x}, '')" for x in ("role", "text"))
    digest = f"unhex(sha2(concat(octet_length({role}), ':', {role}, {text}), 256)) AS digest"
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.expr(f"{role} AS role"), F.expr(digest), F.regexp_count(F.expr(text), F.lit(WORD)).cast("long").alias("words"))
    return numbered(cut_parquet(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]).drop("turn", "role")


def shared_openings(numbered_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt: the first h turns of conversation c - c % 20, then its own after its first h, with
    h = crc32(c) % 4. Returns (conv_id, at, digest, words) of the turns, and (conv_id, length).

    The opening is all of the other conversation where it has fewer turns, and none where it is absent. % has the sign of c.
    """
    convs = numbered_turns.groupBy("conv_id").agg(F.max("size").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).withColumn("base", F.expr(f"conv_id - conv_id % {SHARED}"))
    heads = numbered_turns.where((F.col("conv_id") % SHARED == 0) & (F.col("at") < OPENING - 1))
    have = convs.where(f"conv_id % {SHARED} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = cut_parquet(convs.join(have, "base", "left").withColumn("taken", F.expr("least(h, coalesce(base_own, 0))")))
    own = numbered_turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("at >= h").select("conv_id", F.expr("at - h + taken AS at"), "digest", "words")
    opening = convs.select("conv_id", "base", "taken").join(heads.select(F.col("conv_id").alias("base"), "at", "digest", "words"), "base").where("at < taken").select("conv_id", "at", "digest", "words")
    return own.unionByName(opening), convs.select("conv_id", F.expr("taken + greatest(own - h, 0) AS length"))


def _nodes(rebuilt: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, b0.., n, conv_id, words, q0..) for each node but the root, and (conv_id, length, b0..) for each conversation's end.

    A prefix is known by the sums, over its turns, of 32-bit parts of hashes of (place, turn digest): b0.. of the prefix, q0..
    of its parent's. Sums need no order, so a block's digest is what its turns add, and prefixes at block ends are running
    sums over blocks: chunks of blocks first, then over one row a chunk, so that a long conversation is many groups.
    Conversations are grouped by what stands before a block and what it adds; each such value goes on with the smallest
    conversation that has it, and the number of those that do. Only where a prefix has several values for its next block are
    turns grouped by prefix; elsewhere the turns of the one value are nodes as they are.
    """
    lanes = [F.expr(f"shiftrightunsigned(xxhash64(digest, at, {i // 2}), 32)" if i % 2 else f"xxhash64(digest, at, {i // 2}) & 4294967295").alias(f"a{i}") for i in range(LANES)]
    rows = cut_parquet(rebuilt.select("conv_id", "at", F.expr(f"at div {BLOCK} AS block"), "words", *lanes))
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(f"a{i}").alias(f"s{i}") for i in range(LANES)], F.count(F.lit(1)).alias("turns"))
    blocks = blocks.withColumn("chunk", F.expr(f"block div {CHUNK}"))
    inside = "OVER (PARTITION BY conv_id, chunk ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = cut_parquet(blocks.selectExpr("*", *[f"coalesce(sum(s{i}) {inside}, 0) AS p{i}" for i in range(LANES)]))
    chunks = blocks.groupBy("conv_id", "chunk").agg(*[F.sum(f"s{i}").alias(f"c{i}") for i in range(LANES)])
    ends = chunks.groupBy("conv_id").agg(*[F.sum(f"c{i}").alias(f"b{i}") for i in range(LANES)])
    later = "OVER (PARTITION BY conv_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    long = chunks.where("chunk > 0").select("conv_id").distinct()
    chunks = chunks.join(long, "conv_id", "left_semi").selectExpr("conv_id", "chunk", *[f"coalesce(sum(c{i}) {later}, 0) AS c{i}" for i in range(LANES)]).where("chunk > 0")
    first, rest = blocks.where("chunk = 0"), blocks.where("chunk > 0").join(chunks, ["conv_id", "chunk"])
    kept = ["conv_id", "block", "turns", *[f"s{i}" for i in range(LANES)]]
    blocks = first.select(*kept, *[f"p{i}" for i in range(LANES)]).unionByName(rest.selectExpr(*kept, *[f"p{i} + c{i} AS p{i}" for i in range(LANES)]))

    before = ["block", *[f"p{i}" for i in range(LANES)]]
    values = cut_parquet(blocks.groupBy(*before, "turns", *[f"s{i}" for i in range(LANES)]).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
    named = ["conv_id", *before, "n"]
    first, rest = values.where("block = 0"), values.where("block > 0")
    several = F.lit(first.limit(2).count() > 1)  # the root's, which all conversations share
    counts = rest.groupBy(*before).agg(F.count(F.lit(1)).alias("values"))
    values = first.select(*named, several.alias("diverge")).unionByName(rest.join(counts, before).select(*named, (F.col("values") > 1).alias("diverge")))
    inner = "OVER (PARTITION BY conv_id, block ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    found = rows.join(values, ["conv_id", "block"]).selectExpr("conv_id", "at + 1 AS depth", "n", "words", "diverge", *[f"a{i}" for i in range(LANES)], *[f"p{i} + sum(a{i}) {inner} AS b{i}" for i in range(LANES)])
    found = cut_parquet(found.selectExpr("conv_id", "depth", "n", "words", "diverge", *[f"b{i}" for i in range(LANES)], *[f"b{i} - a{i} AS q{i}" for i in range(LANES)]))
    key = ["depth", *[f"b{i}" for i in range(LANES)]]
    refined = found.where("diverge").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("words").alias("words"), *[F.max(f"q{i}").alias(f"q{i}") for i in range(LANES)])
    nodes = found.where("NOT diverge").drop("diverge").unionByName(refined)
    return nodes, lengths.join(ends, "conv_id", "left").selectExpr("conv_id", "length", *[f"coalesce(b{i}, 0) AS b{i}" for i in range(LANES)])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id), sorted, as rows (node, first, ids) of up to IDS_BYTES of comma-joined ids."""
    held, ids, room = None, [], 0
    out: tuple[list, list, list] = ([], [], [])

    def close():
        if ids:
            for x, y in zip(out, (held, ids[0], ",".join(map(str, ids)))):
                x.append(y)

    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != held or room >= IDS_BYTES:
                close()
                held, ids, room = node, [], 0
            ids.append(conv)
            room += 21
        if len(out[0]) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["node", "first", "ids"])
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["node", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first, ids), sorted, as (node, ends_sha256), a state of the hash at a time."""
    held, state = None, None
    for batch in batches:
        nodes, found = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node != held:
                if state:
                    nodes.append(held)
                    found.append(state.hexdigest())
                held, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): SHA-256 of each node's ids in ascending order, joined by commas.

    Ids are dealt by range and joined to rows of 64 KB there; a node's rows then meet in order in one task, since the hash
    is sequential, and stream through one state, so memory does not grow with the node.
    """
    joined = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_ids, "node string, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed_ids, "node string, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(conv_id, depth, *sums): what each node and all below it hold of `sums`, by doubling.

    `nodes` has (conv_id, depth, parent_conv_id, *sums); conv_id and depth name a node. In round j, what a node holds of the
    2 ** j levels from itself down is added to the ancestor 2 ** j levels up; then pointers double. A round has only the
    nodes that deep, so rounds are few and small but for long conversations, and their number is the logarithm of the depth.
    """
    parts = [nodes.select("conv_id", "depth", *sums)]
    active, step = nodes.where("depth > 0").select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *sums), 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        given = cut_parquet(active.groupBy("up", (F.col("depth") - step).alias("depth")).agg(*[F.sum(x).alias(x) for x in sums]).withColumnRenamed("up", "conv_id"))
        parts.append(given)
        if 2 * step <= deepest:
            far = active.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("up_up"))
            more = given.select("conv_id", "depth", *[F.col(x).alias(f"{x}_more") for x in sums])
            active = active.where(F.col("depth") >= 2 * step).join(far, ["up", "depth"]).join(more, ["conv_id", "depth"], "left")
            active = cut_parquet(active.select("conv_id", "depth", F.col("up_up").alias("up"), *[(F.col(x) + F.coalesce(f"{x}_more", F.lit(0))).alias(x) for x in sums]))
        step *= 2
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("conv_id", "depth").agg(*[F.sum(x).alias(x) for x in sums])


def prefix_trie(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    `rebuilt` has (conv_id, at, digest, words) for each turn, `lengths` (conv_id, length) for each conversation, those
    without turns too. No conversations make no node, not even a root. Repeated conversations are members of the same nodes.
    A prefix is known by 128 bits of sums of hashes of its turns' SHA-256 digests and places.
    """
    nodes, ends = _nodes(rebuilt, lengths)
    key = [f"b{i}" for i in range(LANES)]
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    top = F.lit((whole.first() or [None])[0]).cast("long").alias("parent_conv_id")
    nodes = cut_parquet(nodes)
    up = nodes.selectExpr("depth + 1 AS depth", *[f"b{i} AS q{i}" for i in range(LANES)], "conv_id AS parent_conv_id")
    first = nodes.where("depth = 1").withColumn("parent_conv_id", top)
    under = nodes.where("depth > 1").join(up, ["depth", *[f"q{i}" for i in range(LANES)]])
    root = whole.selectExpr("conv_id", "0L AS depth", "CAST(null AS long) AS parent_conv_id", "n", "0L AS words", *[f"0L AS b{i}" for i in range(LANES)])
    nodes = cut_parquet(first.select(root.columns).unionByName(under.select(root.columns)).unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_parquet(nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]))
    sums = nodes.selectExpr("conv_id", "depth", "parent_conv_id", "if(n_children = 0, 1L, 0L) AS n_leaves", "(n - 1) * words AS saved_tokens")
    sums = subtree_sums(sums, ["n_leaves", "saved_tokens"])
    named = "concat_ws(' ', {}, " + _each("b{}") + ") AS node"
    digests = hashed_ends(ends.selectExpr(named.format("length"), "conv_id"))
    found = nodes.selectExpr("*", named.format("depth")).join(digests, "node", "left").join(sums, ["conv_id", "depth"])
    return found.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; see shared_openings and prefix_trie."""
    return prefix_trie(*shared_openings(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = f"""
WITH RECURSIVE ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS own, {CRC32.format('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS base FROM ordered GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN ordered o ON o.conv_id = base AND place <= h
  UNION ALL
  SELECT c.conv_id, place - h + (SELECT count(*) FROM ordered b WHERE b.conv_id = base AND b.place <= h), role, text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND place > h),
prefixes AS (
  SELECT conv_id, place AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    string_agg(sha256(strlen(role) || ':' || role || text), '/' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place) || '/' AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM prefixes GROUP BY path, depth),
edges AS (SELECT c.path, c.depth, p.path AS up FROM nodes c JOIN nodes p ON p.depth = c.depth - 1 AND p.path = left(c.path, 65 * p.depth)),
counts AS (SELECT n.*, (SELECT count(*) FROM edges e WHERE e.up = n.path AND e.depth = n.depth + 1) AS n_children FROM nodes n),
trees AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.words)::BIGINT AS saved_tokens FROM counts a JOIN counts b ON b.depth >= a.depth AND left(b.path, 65 * a.depth) = a.path GROUP BY a.path),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM prefixes JOIN last USING (conv_id, depth) GROUP BY path)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counts c JOIN trees USING (path) LEFT JOIN edges e ON e.path = c.path LEFT JOIN nodes p ON p.path = e.up LEFT JOIN ends ON ends.path = c.path
"""
