"""Byte-level BPE: recursive queries of DuckDB, inside tasks, encode distinct pieces; ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, Numbered
from .common import alone, documents, hold, slices

#: Bytes of the pieces that one recursive query contracts, and of the longest piece that it is given.
QUERY_BYTES = 100_000
LONG_PIECE = 256
#: Bits of a place in a long piece, below its pair's rank.
PLACE_BITS = 40
#: Distinct pieces, and chunks, that a worker keeps before it drops the later half of them.
KEPT_PIECES = 150_000
#: What DuckDB may use in a worker.
MEMORY = "150MB"

ENCODE = """
WITH RECURSIVE state(word, tokens, done) AS (
  SELECT word, tokens, false FROM pieces
  UNION ALL
  SELECT s.word,
         CASE WHEN f.best IS NULL THEN s.tokens
              ELSE list_concat(list_append(s.tokens[:(f.best & 65535) - 1], (f.best >> 16)::INTEGER), s.tokens[(f.best & 65535) + 2:]) END,
         f.best IS NULL
  FROM state s LEFT JOIN (
    SELECT p.word, min((m.rank << 16) | p.place) AS best
    FROM (SELECT word, place, (a::BIGINT << 16) | b AS pair
          FROM (SELECT word, unnest(range(1, len(tokens))) AS place, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b FROM state WHERE NOT done)) p
    JOIN merges m ON m.pair = p.pair
    GROUP BY p.word) f ON f.word = s.word
  WHERE NOT s.done)
SELECT word, tokens FROM state WHERE done ORDER BY word
"""
#: Tokens in order, one thread: the aggregate takes them as they come. Bytes stand as the characters of the same numbers.
DECODE = """
SELECT chunk, string_agg(latin, '') AS bytes
FROM (SELECT t.chunk, v.latin FROM tokens t JOIN vocabulary v ON v.rank = t.token ORDER BY t.place) GROUP BY chunk ORDER BY chunk
"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Bpe:
    """Ranks of a file as tables of an in-memory DuckDB."""

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([c])] for c in range(256)], np.int32)
        pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.array([a * 65536 + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.pairs = dict(zip(self.keys.tolist(), self.values.tolist()))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self._table("merges", pa.table({"pair": self.keys, "rank": self.values}))
        self._table("vocabulary", pa.table({"rank": pa.array(list(self.ranks.values()), pa.int32()), "latin": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self._forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each)."""
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        self._table("pieces", pa.table({"word": np.arange(len(words)), "tokens": pa.ListArray.from_arrays(ends, flat)}))
        tokens = self.db.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
        return tokens.flatten().to_numpy(zero_copy_only=False), np.diff(tokens.offsets.to_numpy())

    def _contract(self, word: bytes) -> np.ndarray:
        """A long piece: the cheapest pair, leftmost first, from a heap of (rank, place) over linked places.

        Each merge leaves two new pairs at most, so time grows as n log n with the piece.
        """
        n = len(word)
        first = self.single[np.frombuffer(word, np.uint8)].astype(np.int64)
        tokens, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (first, np.arange(1, n + 1), np.arange(-1, n - 1)))
        pairs = first[:-1] << 16 | first[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == pairs)
        heap = (self.values[at][places] << PLACE_BITS | places).tolist()
        heapq.heapify(heap)
        rank_of, mask = self.pairs.get, (1 << PLACE_BITS) - 1
        while heap:
            x = heapq.heappop(heap)
            rank, i = x >> PLACE_BITS, x & mask
            j = after[i]
            if tokens[i] < 0 or j >= n or rank_of(tokens[i] << 16 | tokens[j]) != rank:
                continue  # what was there has been merged meanwhile
            k, h = after[j], before[i]
            tokens[i], tokens[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
                new = rank_of(rank << 16 | tokens[k])
                if new is not None:
                    heapq.heappush(heap, new << PLACE_BITS | i)
            if h >= 0:
                new = rank_of(tokens[h] << 16 | rank)
                if new is not None:
                    heapq.heappush(heap, new << PLACE_BITS | h)
        found = np.frombuffer(tokens, np.int32)
        return found[found >= 0].astype(np.int64)

    def _fill(self) -> None:
        """Ids of the pieces that have got numbers since the last time."""
        new = list(islice(reversed(self.number), len(self.number) - len(self.sizes)))[::-1]
        words = [piece.encode("utf-8", "surrogatepass") for piece in new]
        known = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts = [(np.flatnonzero(known >= 0), known[known >= 0], np.ones(int((known >= 0).sum()), np.int64))]
        for i in np.flatnonzero((known < 0) & (lengths > LONG_PIECE)).tolist():
            tokens = self._contract(words[i])
            parts.append((np.array([i]), tokens, np.array([len(tokens)])))
        short = np.flatnonzero((known < 0) & (lengths <= LONG_PIECE))
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // QUERY_BYTES)) + 1):
            if len(some):
                parts.append((some, *self._query([words[i] for i in some.tolist()])))
        sizes = np.zeros(len(new), np.int64)
        for at, _, own in parts:
            sizes[at] = own
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.uint32)
        for at, flat, own in parts:
            ids[np.repeat(starts[at] - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        self.starts = np.append(self.starts, len(self.ids) + starts)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str], sure: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each); each match of the pattern is a piece of its own."""
        if len(self.number) > KEPT_PIECES:
            self._halve()
        number, split = self.number.__getitem__, self.pattern.findall
        lists = [[*map(number, split(x))] for x in texts]
        self._fill()
        every = np.fromiter(chain.from_iterable(lists), np.int64)
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[every] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        total = np.append(0, ends)[np.cumsum([len(x) for x in lists])] if lists else np.zeros(0, np.int64)
        return self.ids[at], np.diff(np.append(0, total))

    def _halve(self) -> None:
        n = len(self.number) // 2
        self.number = Numbered(islice(self.number.items(), n))
        self.ids = self.ids[: int(self.starts[n])].copy()
        self.starts, self.sizes = self.starts[:n].copy(), self.sizes[:n].copy()

    def _forget(self) -> None:
        self.number = Numbered()
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [b""] * len(sizes)
        step = max(1, int(QUERY_BYTES // max(1.0, sizes.mean()))) if len(sizes) else 1
        ends = np.append(0, np.cumsum(sizes))
        for a in range(0, len(sizes), step):
            b = min(a + step, len(sizes))
            part = flat[ends[a] : ends[b]]
            self._table("tokens", pa.table({"chunk": np.repeat(np.arange(a, b), sizes[a:b]), "place": np.arange(len(part)), "token": part.astype(np.int32)}))
            rows = self.db.sql(DECODE).to_arrow_table()
            for chunk, text in zip(rows.column("chunk").to_pylist(), rows.column("bytes").to_pylist()):
                out[chunk] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def _tables(path: str, pattern: str) -> tuple[Bpe, ChunkTable]:
    bpe = Bpe(path, pattern)
    return bpe, ChunkTable(bpe.encode, KEPT_PIECES)


def _encode(path: str, pattern: str, with_ids: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe")
        bpe, table = _tables(path, pattern)
        hold("bpe", _tables.cache_clear)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                numbers = table.numbers([t or "" for t in part.column(1).to_pylist()])
                decoded = table.decoded  # after numbers(), which may drop some
                if len(decoded) < table.count:
                    done = len(decoded)
                    fresh = table.ids[table.starts[done] :] if done < len(table.starts) else table.ids[:0]
                    decoded += bpe.decode(fresh, table.sizes[done:])
                flat, sizes = table.gather(numbers)
                ends = np.append(0, np.cumsum(sizes))
                raw = flat.astype("<u4").tobytes()
                runs = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]
                texts = [b"".join(map(decoded.__getitem__, x.tolist())) for x in numbers]
                columns = [part.column(0), pa.array(sizes), pa.array([hashlib.sha256(r).hexdigest() for r in runs]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(runs, pa.binary())] if with_ids else []), names)

    return encoded


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, and their decoding.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit integers).
    Each match of the pattern is encoded separately, without special tokens. One pass without a shuffle: a task splits
    its texts, and a recursive query contracts the leftmost cheapest pair of every distinct piece that its worker hasn't
    met, until no pair is left; an ordered aggregation turns ids back to bytes. Pieces of over 256 bytes are contracted
    by the same rule outside the query, which would hold each of their states, from a heap: one of 1 MB takes seconds.

    Null text counts as empty: no ids, digests of nothing. Repeated rows each get their row; an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_encode(path or default_path(), pattern or default_pattern(), with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op2_byte_bpe(spark, sf_dir) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
