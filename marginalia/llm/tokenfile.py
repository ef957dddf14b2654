"""Token ids in patched frame-of-reference blocks, in files in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import alone, documents, hold, shared_dir, slices

#: Ids of a block, the share of a block's offsets that its width must hold, and the id that ends a document.
BLOCK = 128
PERCENTILE = 0.9
END_ID = 2
#: Ids of a page, about: documents in a row whose ids share blocks. A longer document is a page of its own at most.
PAGE_IDS = 1 << 16
#: Chunks that one call of the tokenizer encodes.
JOINED = 100


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """[row, BLOCK] offsets as bytes of `width` bits each, little end first."""
    if width == 0:
        return np.zeros((len(values), 0), np.uint8)
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8)
    out = np.zeros((len(values), width, BLOCK // 8 // 8), np.uint64)
    groups = values.astype(np.uint64).reshape(len(values), BLOCK // 64, 64)
    for i in range(64):  # 64 values of `width` bits fill `width` words
        word, shift = divmod(i * width, 64)
        out[:, word, :] |= groups[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1, :] |= groups[:, :, i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(0, 2, 1)).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack: [row, bytes] to [row, BLOCK]."""
    if width == 0:
        return np.zeros((len(raw), BLOCK), np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}").astype(np.uint32)
    words = np.ascontiguousarray(raw).view("<u8").reshape(len(raw), BLOCK // 64, width)
    out = np.zeros((len(raw), BLOCK // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = value & mask
    return out.reshape(len(raw), BLOCK).astype(np.uint32)


def encode_blocks(flat: np.ndarray, sizes: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], list[bytes]]:
    """(payloads, block starts) of runs of ids; runs are `sizes` long, none is empty.

    A run is cut into blocks of BLOCK ids; its last block is filled up with its last id. A block holds its minimum
    (4 bytes), width (1), count of exceptions (1), the low `width` bits of every offset from the minimum, then the
    places (1 byte each) and the high parts (4 bytes each) of the offsets that are wider. The width is what the given
    share of the block's offsets needs. Block starts are byte positions in the payload (4 bytes each).
    """
    blocks = -(-sizes // BLOCK)
    last = np.cumsum(blocks)
    total = int(last[-1]) if len(last) else 0
    ends = np.cumsum(sizes)
    grid = np.repeat(flat[ends - 1], blocks)[:, None].repeat(BLOCK, axis=1) if total else np.zeros((0, BLOCK), np.uint32)
    first = np.repeat((last - blocks) * BLOCK - (ends - sizes), sizes)
    grid.reshape(-1)[np.arange(len(flat)) + first] = flat
    base = grid.min(axis=1) if total else np.zeros(0, np.uint32)
    offsets = grid - base[:, None]
    at = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    common = np.partition(offsets, at, axis=1)[:, at] if total else np.zeros(0, np.uint32)
    width = np.where(common > 0, np.floor(np.log2(np.maximum(common, 1))).astype(np.int64) + 1, 0)
    wide = offsets >> np.minimum(width, 31)[:, None].astype(np.uint32)
    wide[width == 32] = 0
    exceptions = (wide > 0).sum(axis=1)
    lengths = 6 + width * BLOCK // 8 + 5 * exceptions
    places = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        head = np.zeros((len(rows), 6), np.uint8)
        head[:, :4] = base[rows].astype("<u4").view(np.uint8).reshape(-1, 4)
        head[:, 4], head[:, 5] = w, exceptions[rows]
        low = offsets[rows] & np.uint32((1 << int(w)) - 1)
        body = np.hstack([head, _pack(low, int(w))])
        out[places[rows][:, None] + np.arange(body.shape[1])] = body
    row, spot = np.nonzero(wide)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (places + lengths - 5 * exceptions)[row]
    out[tail + turn] = spot
    out[(tail + exceptions[row] + 4 * turn)[:, None] + np.arange(4)] = wide[row, spot].astype("<u4")[:, None].view(np.uint8)
    raw = out.tobytes()
    edges = np.append(0, last)
    starts = np.append(places, len(out))
    payloads = [raw[starts[a] : starts[b]] for a, b in zip(edges[:-1], edges[1:])]
    index = [(places[a:b] - places[a]).astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return payloads, index


def decode_blocks(payloads: list[bytes], index: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of all runs, in order."""
    if not len(payloads):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.cumsum([0, *map(len, payloads)])
    starts = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + b for x, b in zip(index, begin)])
    base = raw[starts[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    width, exceptions = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        grid[rows] = _unpack(raw[starts[rows][:, None] + 6 + np.arange(w * BLOCK // 8)], int(w))
    row = np.repeat(np.arange(len(starts)), exceptions)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (starts + 6 + width * BLOCK // 8)[row]
    high = raw[(tail + exceptions[row] + 4 * turn)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    grid[row, raw[tail + turn]] |= high << width[row].astype(np.uint32)
    grid += base[:, None]
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(sizes)
    first = np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (ends - sizes), sizes)
    return grid.reshape(-1)[np.arange(int(ends[-1])) + first]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _table(path: str) -> tuple:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [x.content for x in own.get_added_tokens_decoder().values()]
    widths = np.zeros(own.get_vocab_size(), np.int64)  # bytes of a token: its characters each stand for one
    for token, i in own.get_vocab().items():
        widths[i] = len(token)

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in own.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[str], sure: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        # chunks that are a space and what is no white space can be told apart by their bytes, so many share a call
        some = [x for x, yes in zip(chunks, sure) if yes]
        runs = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
        joined = ids_of(["".join(r) for r in runs])
        lengths = np.array([len(x.encode("utf-8", "replace")) for x in some], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *joined])
        last = np.searchsorted(np.cumsum(widths[flat]), np.cumsum(lengths), side="right")
        rest = ids_of([x for x, yes in zip(chunks, sure) if not yes])
        yes = np.array(sure, bool)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[yes] = np.diff(last, prepend=0)
        sizes[~yes] = [len(x) for x in rest]
        out = np.zeros(int(sizes.sum()), np.uint32)
        out[np.repeat(yes, sizes)] = flat
        out[np.repeat(~yes, sizes)] = np.concatenate([np.zeros(0, np.int64), *rest])
        return out, sizes

    return ChunkTable(encode), special, own


def _write(path: str, end_id: int, percentile: float):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("tokens")
        table, special, own = _table(path)
        hold("tokens", _table.cache_clear)
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column(1).to_pylist()]
                numbers = table.numbers(texts)
                flat, sizes = table.gather(numbers)
                ends = np.cumsum(sizes)
                runs = np.split(flat, ends[:-1])
                for i, text in enumerate(texts):  # a special token may hold white space, so such a text is encoded whole
                    if any(x in text for x in special):
                        runs[i] = np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
                sizes = np.array([len(r) + 1 for r in runs], np.int64)
                flat = np.concatenate([x for r in runs for x in (r, np.array([end_id], np.uint32))])
                ahead = np.cumsum(sizes) - sizes
                first = np.flatnonzero(np.diff(ahead // PAGE_IDS, prepend=-1))  # documents that begin a page
                ends = np.append(first[1:], len(sizes))
                totals = np.add.reduceat(sizes, first)
                payloads, index = encode_blocks(flat, totals, percentile)
                begin = before + ahead[first]
                before += int(sizes.sum())
                listed = lambda values: pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)
                columns = [pa.array(np.full(len(first), shard)), pa.array(begin), pa.array(totals), listed(part.column(0)), listed(pa.array(sizes)), pa.array(index, pa.binary()), pa.array(payloads, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "begin", "n_ids", "doc_ids", "sizes", "block_starts", "payload"])

    return written


def write_token_files(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, percentile: float = PERCENTILE) -> None:
    """Encode every whole text and write the ids to `out` in ascending doc_id order (null first).

    Texts are dealt by ranges of doc_id and sorted before they are encoded, so one file holds one range: that is the
    one shuffle. A file is Parquet; a row is a page of documents in a row, whose ids share blocks: their doc_ids and sizes,
    the blocks, where each block begins, and how many ids precede the page in its shard, so a reader can seek a document
    by doc_id and a block by its start.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kinds = "shard long, begin long, n_ids long, doc_ids array<long>, sizes array<long>, block_starts binary, payload binary"
    dealt.mapInArrow(_write(path or default_path(), end_id, percentile), kinds).write.option("compression", "none").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(6), 2 << 20):
            part = batch.slice(start, stop - start)
            totals = part.column(2).to_numpy()
            flat = decode_blocks(part.column(6).to_pylist(), part.column(5).to_pylist(), totals).astype("<u4")
            sizes = part.column(4).flatten().to_numpy()
            ends = np.cumsum(sizes)
            page = np.searchsorted(np.cumsum(totals), ends, side="left")
            begin = part.column(1).to_numpy()[page] + ends - sizes - (np.cumsum(totals) - totals)[page]
            runs = [flat[b - n : b].tobytes() for b, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[page]), part.column(3).flatten(), pa.array(begin), pa.array(sizes), pa.array(runs, pa.binary())], ["shard", "doc_id", "begin", "n_tokens", "ids"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _read(batches):
        sums = pa.array([zlib.crc32(x) for x in part.column(4).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*part.columns[:4], sums], ["shard", "doc_id", "begin", "n_tokens", "ids_crc32"])


def read_token_files(spark, path: str, summed: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of written files, or ids_crc32 in place of ids; start counts all ids before the document.

    A shard's first position is the sum of the shards before it: one row a shard, which is broadcast.
    """
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    last = "ids_crc32 long" if summed else "ids binary"
    rows = files.select("shard", "begin", "n_ids", "doc_ids", "sizes", "block_starts", "payload").mapInArrow(_summed if summed else _read, f"shard long, doc_id long, begin long, n_tokens long, {last}")
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", last.split()[0])


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write documents' token ids to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Every document ends with `end_id`, also a null or empty one, which has no other id. Ties: rows that repeat a doc_id
    are ordered by their text. Null ids come first. An empty table gives files without rows, and no rows. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    write_token_files(docs, out, id_col, text_col, path, end_id)
    return read_token_files(spark, out, summed=True)


def op3_token_files(spark, sf_dir) -> DataFrame:
    return token_files(documents(spark, sf_dir))
