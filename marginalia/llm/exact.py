"""Exact dedup: digests of a batch are screened by static binary-fuse filters of an immutable snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, cut, cut_parquet, documents, mix64, text_or_empty

#: Digests of a snapshot to a bucket, on average: what one task holds to build or to ask a filter.
BUCKET_ROWS = 250
#: Slots (a power of two) of the fixed bit map that tells which texts may have an equal one.
SCREEN_BITS = 24
#: The most digests of different texts that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Three slots of each key, in neighbouring segments, and its 8-bit fingerprint."""
    h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
    low = np.uint64(segment - 1)
    slots = [first + i * segment + ((mix64(h + np.uint64(i + 1)) >> np.uint64(7)) & low).astype(np.int64) for i in range(3)]
    return slots, (mix64(h ^ np.uint64(0x5BD1E995)) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a static filter that holds every one of `keys` (uint64).

    Keys that are alone in a slot are peeled round by round, and slots are set in the reverse order, so that the three
    slots of a key always give its fingerprint. A seed that can't be peeled is replaced by the next.
    """
    keys = np.unique(keys)
    segment = 1 << max(2, min(18, int(np.log(max(len(keys), 2)) / np.log(3.33) + 2.25)))
    segments = max(1, -(-int(len(keys) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(len(keys), 2))) + 8) // segment))
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        slots, prints = _places(keys, seed, segment, segments)
        alive, rounds = np.arange(len(keys)), []
        while len(alive):
            spots = np.concatenate([s[alive] for s in slots])
            count = np.bincount(spots, minlength=size)
            owner = np.bincount(spots, weights=np.tile(alive, 3), minlength=size)
            alone = np.flatnonzero(count == 1)
            peeled, at = np.unique(owner[alone].astype(np.int64), return_index=True)
            if not len(peeled):
                break
            rounds.append((peeled, alone[at]))
            gone = np.zeros(len(keys), bool)
            gone[peeled] = True
            alive = alive[~gone[alive]]
        if not len(alive):
            table = np.zeros(size, np.uint8)
            for peeled, at in reversed(rounds):
                table[at] = prints[peeled] ^ table[slots[0][peeled]] ^ table[slots[1][peeled]] ^ table[slots[2][peeled]]
            return seed, segment, segments, table.tobytes()
    raise ValueError("no seed gives a filter")


def ask_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    slots, prints = _places(keys, seed, segment, segments)
    held = np.frombuffer(table, np.uint8)
    return (held[slots[0]] ^ held[slots[1]] ^ held[slots[2]]) == prints


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int(x[:16].ljust(16, "0"), 16) for x in column.to_pylist()], dtype=np.uint64)


def _build(table: pa.Table) -> pa.Table:
    seed, segment, segments, held = build_filter(_keys(table["digest"]))
    return pa.table({"bucket": table["bucket"].slice(0, 1), "seed": pa.array([seed], pa.int64()), "segment": pa.array([segment], pa.int64()), "segments": pa.array([segments], pa.int64()), "held": pa.array([held], pa.binary())})


def _ask(batch: pa.Table, filters: pa.Table) -> pa.Table:
    alone("exact")
    maybe = np.zeros(batch.num_rows, bool)
    if batch.num_rows and filters.num_rows:
        row = filters.slice(0, 1).to_pylist()[0]
        maybe = ask_filter(_keys(batch["digest"]), row["seed"], row["segment"], row["segments"], row["held"])
    return batch.append_column("maybe", pa.array(maybe))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def snapshot_tables(digests: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(exact, filters) of an immutable snapshot's digests, one row each, in hexadecimal: written once, read by every batch.

    exact has a bucket for each digest, beside its other columns; filters has a binary-fuse filter for each bucket.
    """
    exact = cut_parquet(digests.select(_bucket(buckets), *digests.columns))
    kinds = "bucket int, seed long, segment long, segments long, held binary"
    return exact, cut_parquet(exact.select("bucket", "digest").groupBy("bucket").applyInArrow(_build, kinds))


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """`batch` (distinct digests) with their bucket and `maybe`: false where the filter proves that the snapshot lacks the digest."""
    rows = batch.select(_bucket(buckets), *batch.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_ask, f"{kinds}, maybe boolean")


def _kept_rows(bits: int, held: dict[int, bytes]):
    table = np.zeros(1 << (bits - 3), np.uint8)
    for number, piece in held.items():
        table[number * 4096 : (number + 1) * 4096] = np.frombuffer(piece, np.uint8)[: len(table)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("exact")
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)).drop_columns(["slot"])

    return rows


def dedup_batch(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.sha2(text, 256), bucket_rows: int = BUCKET_ROWS, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """Groups of equal texts over an immutable snapshot and a new batch: the rows of `docs` where `incoming` is true.

    Returns a row for each row: doc_id, in_snapshot, keep_id, group_size, kept, text_sha256. Of equal texts the row with
    the largest doc_id stays. Texts are digested once; the snapshot's distinct digests are written as exact buckets, with
    a filter for each. Equal digests within the batch are grouped separately; each then asks the filter of its bucket.
    What the filter rejects is new, and its group is that of the batch; only the rest joins the exact buckets. Where a
    digest has several rows, their texts are compared byte by byte: the least and the greatest text of a digest, found
    with partial results before the shuffle, are the same. Should they differ, rows of that digest are grouped by text.

    Null counts as empty text. Ties: rows that repeat a doc_id and its text count in group_size and all have its kept.
    Null doc_ids are smaller than others. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), (~F.coalesce(incoming, F.lit(False))).alias("in_snapshot"), text.alias("text"), digest(text).alias("digest"))
    marked = cut_parquet(read.select("doc_id", "in_snapshot", "digest", F.sha2("text", 256).alias("text_sha256")))  # a row a document, without texts
    groups = marked.groupBy("in_snapshot", "digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    buckets = max(1, -(-marked.where("in_snapshot").count() // bucket_rows))
    old, filters = snapshot_tables(groups.where("in_snapshot").drop("in_snapshot"), buckets)
    screened = cut_parquet(screen(groups.where("not in_snapshot").drop("in_snapshot"), filters, buckets))
    other = screened.where("maybe").select("bucket", "digest", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    met = old.join(other, ["bucket", "digest"], "full").select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.coalesce("group_size", F.lit(0)) + F.coalesce("new_size", F.lit(0))).alias("group_size"))
    found = cut(met.unionByName(screened.where("not maybe").select("digest", "keep_id", "group_size")).where("group_size > 1"))

    # which texts to compare: a bit map of fixed size of the digests of several rows (2 MB at 24 bits)
    slot = F.pmod(F.xxhash64("digest"), F.lit(1 << screen_bits))
    bits = found.select((slot + 1).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("number")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    held = {r["number"] - 1: bytes(r["bits"]) for r in bits.collect()}
    may = read.select("digest", "text", "doc_id", slot.alias("slot")).mapInArrow(_kept_rows(screen_bits, held), "digest string, text string, doc_id long")
    unlike = cut(may.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"))

    same = found.join(unlike, "digest", "left_anti")
    out = _verdicts(marked.join(same, "digest", "left"))
    if unlike.isEmpty():
        return out
    of = F.broadcast(unlike) if unlike.count() <= BROADCAST_ROWS else unlike
    texts = may.join(of, "digest").groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = read.join(of, "digest").join(texts, ["digest", "text"]).withColumn("text_sha256", F.sha2("text", 256))
    return _verdicts(marked.join(unlike, "digest", "left_anti").join(same, "digest", "left")).unionByName(_verdicts(apart))


def _verdicts(rows: DataFrame) -> DataFrame:
    keep = F.when(F.coalesce("group_size", F.lit(1)) == 1, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", "in_snapshot", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(snapshot: DataFrame, incoming: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """dedup_batch() of a snapshot and a batch that are tables of their own."""
    pick = lambda side, new: side.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(new).alias("incoming"))
    return dedup_batch(pick(snapshot, False).unionByName(pick(incoming, True)), F.col("incoming"), **options)


def odd_ids(id_col: str = "doc_id") -> Column:
    return F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(2)) == 1


def op6_exact_dedup(spark, sf_dir) -> DataFrame:
    """Two loads of documents: the even ids are the snapshot, the odd ones the new batch."""
    return dedup_batch(documents(spark, sf_dir), odd_ids()).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
