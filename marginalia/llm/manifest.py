"""A Merkle manifest of a table: a leaf for each row, a tree for each language, one root, and an inclusion proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_parquet, documents
from .order import numbered

FANOUT = 2
#: Levels that one pivot holds, so that a row has FANOUT ** LEVELS slots, and the tree takes a shuffle for each LEVELS levels.
LEVELS = 4
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts in a row; nulls are no parts."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(column: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and itself, or a dash if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _pivot(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row for each fanout ** levels consecutive nodes of a group, with the nodes in slots and all hashes above them.

    `nodes` has (part, at, size, node), where node is a struct with a field `hash`. Columns n{level}_{i} are the hashes of
    level 0 (the slots) to `levels` (the one on top, `hash`), w{level} how many nodes the whole group has on the level; a
    group of one node is left as it is, so its levels end there. Expressions are SQL text, a call for each level.
    """
    slots = fanout**levels
    out = nodes.groupBy("part", F.expr(f"at div {slots}").alias("block")).agg(F.max("size").alias("w0"), *[F.expr(f"max(if(at % {slots} = {s}, node, null)) AS node{s}") for s in range(slots)])
    out = out.selectExpr("*", *[f"node{s}.hash AS n0_{s}" for s in range(slots)])
    for level in range(1, levels + 1):
        many, made = f"w{level - 1} > 1", [f"ceil(w{level - 1} / {fanout}) AS w{level}"]
        for i in range(slots // fanout**level):
            children = [f"n{level - 1}_{i * fanout + k}" for k in range(fanout)]
            made.append(f"CASE WHEN NOT {many} THEN n{level - 1}_{i} WHEN {children[0]} IS NOT NULL THEN sha2(concat_ws('', {', '.join(children)}), 256) END AS n{level}_{i}")
        out = out.selectExpr("*", *made)
    return out.withColumn("hash", F.col(f"n{levels}_0"))


def _slots(fanout: int, levels: int) -> str:
    """SQL of an array of what the slots of a pivot's row hold, each with its siblings on the row's levels: the other slots of its run, before and after its own."""
    found = []
    for s in range(fanout**levels):
        path = []
        for level in range(levels):
            own = s // fanout**level
            first = own // fanout * fanout
            before, after = (", ".join(["''", *[f"n{level}_{i}" for i in r]]) for r in (range(first, own), range(own + 1, first + fanout)))
            path.append(f"if(w{level} > 1, struct(concat_ws('', {before}) AS before, concat_ws('', {after}) AS after), null)")
        found.append(f"if(node{s} IS NOT NULL, struct(block * {fanout**levels} + {s} AS at, node{s} AS node, array_compact(array({', '.join(path)})) AS own), null)")
    return f"array_compact(array({', '.join(found)}))"


def build(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of a tree for each group, from the leaves up, each a table in the shared folder; and (part, hash): the groups' tops.

    `nodes` has (part, at, size, node): the leaves of each group, numbered from 0.
    """
    pivots, slots = [], fanout**levels
    widest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        pivots.append(cut_parquet(_pivot(nodes, fanout, levels)))
        if widest <= slots:
            return pivots, pivots[-1].select("part", "hash")
        widest = -(-widest // slots)
        nodes = pivots[-1].select("part", F.col("block").alias("at"), F.ceil(F.col("w0") / slots).alias("size"), F.struct("hash").alias("node"))


def descend(pivots: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(part, node, top, path) for each leaf: its siblings from its own level up to the group's top, then the path that `tops` has.

    `tops` has (part, top, path), a row for each group. A parent's row hands its path to the slots that it holds; on the
    lowest level no row is shuffled but one for each fanout ** levels leaves.
    """
    above = tops.select("part", F.lit(0).cast("long").alias("at"), "top", "path")
    for pivot in reversed(pivots):
        up = above.select(F.col("part").alias("up_part"), F.col("at").alias("up_at"), "top", "path")
        row = pivot.join(up, pivot["part"].eqNullSafe(up["up_part"]) & (pivot["block"] == up["up_at"]))
        found = row.select("part", "top", "path", F.explode(F.expr(_slots(fanout, levels))).alias("slot"))
        above = found.select("part", "slot.at", "slot.node", "top", F.concat("slot.own", "path").alias("path"))
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda found, x: F.sha2(F.concat(x["before"], found, x["after"]), 256))


def manifest(rows: DataFrame, part: str, order: str, leaf: Column, other: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """The manifest of a table: for each row (order, leaf, subroot, root, path, checked_root).

    `part` names the column of the parts (each a tree; nulls are a part), `order` the column that leaves ascend by (null
    first, ties by leaf, so that repeated rows are leaves of their own beside each other), `leaf` the digest of a row.
    Parts' roots, ascending by part (null first), make the tree whose top is the root. `other` is the digest to be
    verified in a leaf's stead (null: the leaf): checked_root is the root that it gives with the leaf's siblings. The text
    of a row is read once, where it lies, and only digests are dealt out. An empty table has no rows. Nothing but the root
    comes to the driver.
    """
    made = rows.select(F.col(part).alias("part"), F.col(order).alias("key"), leaf.alias("hash"), (other if other is not None else F.lit(None).cast("string")).alias("other"))
    leaves = numbered(cut_parquet(made), ["part"], [F.col("key").asc_nulls_first(), F.col("hash")])
    pivots, tops = build(leaves.select("part", "at", "size", F.struct("hash", "key", "other").alias("node")), fanout)
    ranked = numbered(tops.select(F.lit(0).alias("all"), F.col("part").alias("of"), "hash"), ["all"], [F.col("of").asc_nulls_first()])
    over, top = build(ranked.select(F.col("all").alias("part"), "at", "size", F.struct("hash", "of").alias("node")), fanout)
    root = F.lit((top.first() or [None, None])[1]).cast("string")
    roots = descend(over, top.select("part", F.col("hash").alias("top"), F.array().cast(PATH).alias("path")), fanout)
    found = descend(pivots, roots.select(F.col("node.of").alias("part"), F.col("node.hash").alias("top"), "path"), fanout)
    found = found.select(F.col("node.key").alias(order), F.col("node.hash").alias("leaf"), F.col("node.other").alias("other"), F.col("top").alias("subroot"), root.alias("root"), "path")
    return found.withColumn("checked_root", fold(F.coalesce("other", "leaf"), F.col("path"))).drop("other")


def document_leaf(n_chars: Column) -> Column:
    """The digest of a row of documents, with the given number of characters."""
    return digest(*[field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as a leaf, with the digest of its proof and the check of a leaf that was tampered with.

    Repeated rows have a row each; rows of one doc_id are ordered by leaf; a null doc_id comes first and is not tampered
    with; a null language is a part of its own, the first.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = document_leaf(F.col("n_chars").cast("decimal(20,0)") + 1)
    found = manifest(documents(spark, sf_dir), "lang", "doc_id", document_leaf(F.col("n_chars")), F.when(chosen, more))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("checked_root").alias("folded_root"), (F.col("checked_root") == F.col("root")).alias("verified"))


#: Unsigned CRC-32 of the decimal digits of a column {0}: the reflected polynomial 0xEDB88320, a byte at a time.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda v, r: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"


def _sql_field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"


def oracle() -> str:
    def leaf(n: str) -> str:
        return "sha256(" + " || ".join(_sql_field(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"

    def levels(name: str, start: str) -> str:
        return (
            f"{name}(part, level, spot, n, h) AS (SELECT * FROM ({start}) UNION ALL "
            f"SELECT part, level + 1, spot // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY spot)) FROM {name} WHERE n > 1 GROUP BY part, level, spot // 2)"
        )

    leaves = "SELECT lang AS part, 0 AS level, place AS spot, n, leaf AS h FROM numbered"
    parts = "SELECT 0 AS part, 0 AS level, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS spot, count(*) OVER () AS n, h FROM levels WHERE n = 1"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {CRC32.format('doc_id')} % 7 = 0 THEN {leaf('n_chars + 1')} END AS other FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{levels('levels', leaves)},
{levels('upper', parts)},
subroots AS (SELECT part AS lang, h AS subroot, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS turn FROM levels WHERE n = 1),
steps AS (
  SELECT doc_id, leaf, d.level, d.spot % 2 AS side, coalesce(s.h, '') AS sibling FROM numbered JOIN levels d ON d.part IS NOT DISTINCT FROM lang AND d.spot = place >> d.level AND d.n > 1
  LEFT JOIN levels s ON s.part IS NOT DISTINCT FROM lang AND s.level = d.level AND s.spot = xor(d.spot, 1)
  UNION ALL
  SELECT doc_id, leaf, 1000 + d.level, d.spot % 2, coalesce(s.h, '') FROM numbered JOIN subroots r ON r.lang IS NOT DISTINCT FROM numbered.lang JOIN upper d ON d.spot = turn >> d.level AND d.n > 1
  LEFT JOIN upper s ON s.level = d.level AND s.spot = xor(d.spot, 1)),
paths AS (SELECT doc_id, leaf, string_agg(sibling, '' ORDER BY level) AS proof, list({{'side': side, 'sibling': sibling}} ORDER BY level) AS path FROM steps GROUP BY ALL),
folded(doc_id, leaf, left_over, h) AS (
  SELECT n.doc_id, n.leaf, coalesce(path, []), coalesce(other, n.leaf) FROM numbered n LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM n.doc_id AND p.leaf = n.leaf
  UNION ALL
  SELECT doc_id, leaf, left_over[2:], sha256(CASE WHEN left_over[1].side = 1 THEN left_over[1].sibling || h ELSE h || left_over[1].sibling END) FROM folded WHERE len(left_over) > 0)
SELECT n.doc_id, n.leaf, subroot, u.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM numbered n JOIN subroots r ON r.lang IS NOT DISTINCT FROM n.lang JOIN upper u ON u.n = 1
LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM n.doc_id AND p.leaf = n.leaf
JOIN folded f ON f.doc_id IS NOT DISTINCT FROM n.doc_id AND f.leaf = n.leaf AND len(f.left_over) = 0
"""
