"""Nearest neighbours by randomly rotated one-bit codes: estimates with error bounds choose the vectors whose distances are computed."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_parquet

#: Vectors, at most, that the centres are fitted on (those with the least hashes of their ids), and the number of centres.
SAMPLE, CENTRES, ROUNDS = 8192, 16, 6
SEED = 20240601
#: Standard deviations of an estimate that its bound allows: the paper's 1.9 leaves out more.
EPSILON = 4.0
#: A block has so many vectors, but no more components than BLOCK_VALUES; a table has BLOCKS blocks if it is large enough.
LEAST_ROWS, BLOCKS, BLOCK_VALUES, QUERY_ROWS = 256, 64, 1 << 22, 8192
#: Fixed values of the registered query.
QUERY_STEP, NEAREST = 100, 10
#: The signs of the bits of a byte, highest first.
SIGNS = 1.0 - 2.0 * (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1 == 0)


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: the same for a dimension in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(vectors: np.ndarray, k: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced vectors of a bounded sample; centres only tighten bounds, so any are right."""
    centres = vectors[np.unique(np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int))]
    for _ in range(rounds):
        near = nearest_centre(vectors, centres)
        centres = np.array([vectors[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres[np.isfinite(centres).all(axis=1)]


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.nan_to_num((centres**2).sum(axis=1) - 2 * vectors @ centres.T, nan=np.inf).argmin(axis=1)


def centres_for(model: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The centres of a dimension; one at zero for a dimension that the sample does not have."""
    return model[dim] if len(model.get(dim, ())) else np.zeros((1, dim))


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, packed signs of the rotated residual, the residual's length, and how well the signs stand for its direction."""
    near = nearest_centre(vectors, centres)
    rest = (vectors - centres[near]) @ rotation(vectors.shape[1])
    length = np.sqrt((rest**2).sum(axis=1))
    agree = np.abs(rest).sum(axis=1) / np.sqrt(vectors.shape[1])
    return near, np.packbits(rest > 0, axis=1), length, np.divide(agree, length, out=np.ones_like(agree), where=length > 0)


def stacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector that is not null, empty or zero, of finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x != 0)"
    return rows.where(f"vec_id IS NOT NULL AND vector IS NOT NULL AND {sound}")


def build_index(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index of (vec_id, vector) rows, a table in the shared folder with a row for each of them, and its centres by dimension.

    A row has the nearest centre, the packed bits of the rotated residual, the residual's length and the correction scalar.
    Only the centres come from a sample, of SAMPLE rows at most.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(len(row[0]), []).append(row[0])
    with np.errstate(all="ignore"):
        model = {dim: fit_centres(np.array(x, dtype=np.float64)) for dim, x in by_dim.items()}

    def encoded(batches):
        for batch in batches:
            frame = pa.table(batch)
            dims = pa.compute.list_value_length(frame["vector"]).to_numpy()
            for dim in np.unique(dims):
                part = frame.filter(pa.array(dims == dim))
                with np.errstate(all="ignore"):
                    near, codes, length, agree = encode(stacked(part["vector"], dim), centres_for(model, dim))
                made = [pa.array(np.full(len(near), dim, dtype=np.int32)), pa.array(near.astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(length), pa.array(agree)]
                for name, column in zip(("dim", "centre", "code", "length", "agree"), made):
                    part = part.append_column(name, column)
                yield from part.to_batches()

    kind = rows.schema["vector"].dataType.simpleString()
    return cut_parquet(rows.mapInArrow(encoded, f"vec_id long, vector {kind}, dim int, centre int, code binary, length double, agree double")), model


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed from the first component to the last."""
    return np.sqrt(np.cumsum((vectors - query) ** 2, axis=1)[:, -1])


class Block:
    """The index rows of one dimension in one block, to be searched."""

    def __init__(self, rows: pa.Table, dim: int, centres: np.ndarray):
        self.ids = rows["vec_id"].to_numpy()
        self.vectors = stacked(rows["vector"], dim)
        once = pd.DataFrame({"id": self.ids, "v": [x.tobytes() for x in self.vectors + 0.0]}).drop_duplicates().index.to_numpy()
        self.ids, self.vectors = self.ids[once], self.vectors[once]
        self.codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)[once]
        self.near, self.length, self.agree = (rows[x].to_numpy()[once] for x in ("centre", "length", "agree"))
        self.dim, self.centres, self.turned = dim, centres, centres @ rotation(dim)
        self.spread = np.sqrt(np.maximum(0, 1 - self.agree**2)) / self.agree / np.sqrt(max(1, dim - 1))

    def bounds(self, query: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the squared distances from packed bits alone, and lower bounds of them.

        For each byte of a code a table has the sum of the query's rotated residual under the byte's signs.
        """
        rest = query @ rotation(self.dim) - self.turned
        far = np.sqrt((rest**2).sum(axis=1))
        padded = np.zeros((len(rest), 8 * self.codes.shape[1]))
        padded[:, : self.dim] = rest
        table = padded.reshape(len(rest), -1, 8) @ SIGNS.T
        found = np.zeros(len(self.ids))
        for byte in range(self.codes.shape[1]):
            found += table[self.near, byte, self.codes[:, byte]]
        inner = found / np.sqrt(self.dim) / self.agree
        own = far[self.near]
        base = self.length**2 + own**2
        lower = base - 2 * self.length * (inner + epsilon * own * self.spread) - 1e-9 * base
        return base - 2 * self.length * inner, np.where(np.isnan(lower), -np.inf, lower)

    def search(self, query_id: int, query: np.ndarray, k: int, epsilon: float, limit: float | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest rows but those of the query's id: ids, distances, and how many distances were computed.

        Without a limit the 2 k rows of the least estimates are compared; with one, all whose lower bound is within it.
        """
        guess, lower = self.bounds(query, epsilon)
        other = self.ids != query_id
        if limit is None:
            guess = np.where(other & ~np.isnan(guess), guess, np.inf)
            chosen = np.argpartition(guess, 2 * k)[: 2 * k] if len(guess) > 2 * k else np.arange(len(guess))
            chosen = chosen[other[chosen]]
        else:
            chosen = np.flatnonzero(other & (lower <= limit**2))
        found = distances(self.vectors[chosen], query)
        best = np.lexsort((self.ids[chosen], found))[:k]
        return self.ids[chosen][best], found[best], len(chosen)


FOUND = "query_id long, tag long, vec_id long, score double, compared long"


def searcher(model: dict[int, np.ndarray], k: int, epsilon: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nearest of a block of the index for each query of a block of queries."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        dims = pa.compute.list_value_length(queries["query"]).to_numpy()
        for dim in np.unique(dims):
            own = rows.filter(pa.compute.equal(rows["dim"], pa.scalar(int(dim), pa.int32())))
            if not own.num_rows:
                continue
            asked = queries.filter(pa.array(dims == dim))
            with np.errstate(all="ignore"):
                block = Block(own, int(dim), centres_for(model, int(dim)))
                for query_id, tag, limit, query in zip(*(asked[x].to_pylist() for x in ("query_id", "tag", "limit")), stacked(asked["query"], int(dim))):
                    ids, found, compared = block.search(query_id, query, k, epsilon, limit)
                    for column, x in zip(out, ([query_id] * len(ids), [tag] * len(ids), ids.tolist(), found.tolist(), [compared] * len(ids))):
                        column += x
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names=["query_id", "tag", "vec_id", "score", "compared"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score, compared): the k nearest of `vectors` (vec_id, vector) for each of `queries`, nearest first.

    Every row has a code and every code is looked at, in blocks of bounded size: a block of the index meets a block of the
    queries in one task. A first pass compares each block's 2 k best estimates; the k-th of the distances found is a limit
    for the query. A second pass compares every row whose lower bound is within the limit (`compared`: so many of the
    block), and k rows of a block go on. A vector is left out only if its estimate is over `epsilon` standard deviations
    off. Nearness is the Euclidean distance in double precision, infinite where it overflows; ties go to the smaller id.
    Rows of the query's own id are not its candidates; repeated rows count once. An id with several vectors is as many rows
    and, as a query, as many rankings. Vectors of different lengths have no distance, so a query's candidates have its
    length. Empty tables give no rows.
    """
    index, model = build_index(vectors)
    n, widest = index.agg(F.count(F.lit(1)), F.max("dim")).first()
    asked = cut_parquet(queries.dropDuplicates(["vec_id", "vector"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("tag"), F.col("vector").alias("query")))
    rows = max(1, min(max(LEAST_ROWS, -(-n // BLOCKS)), BLOCK_VALUES // (widest or 1)))
    blocks, asked_blocks = max(1, -(-n // rows)), max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("asked_block", every(asked_blocks) if asked_blocks > 1 else F.lit(0))

    def best(asked: DataFrame) -> DataFrame:
        right = asked.withColumn("block", every(blocks)).withColumn("asked_block", F.pmod(F.xxhash64("query_id", "tag"), F.lit(asked_blocks)).cast("int"))
        met = left.groupBy("block", "asked_block").cogroup(right.groupBy("block", "asked_block")).applyInArrow(searcher(model, k, epsilon), FOUND)
        rank = F.row_number().over(W.partitionBy("query_id", "tag").orderBy("score", "vec_id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k)

    first = best(asked.withColumn("limit", F.lit(None).cast("double")))
    limits = cut_parquet(first.groupBy("query_id", "tag").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).otherwise(float("inf")).alias("limit")))
    return best(asked.join(limits, ["query_id", "tag"])).select("query_id", "rank", "vec_id", "score", "compared")


def op12_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for each whose id is divisible by 100."""
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0)).drop("compared")


#: The squares are summed in order, as distances() does.
DISTANCE = "sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y))"
ORACLE = f"""
WITH sound AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, {DISTANCE} AS score FROM sound q JOIN sound c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
QUALIFY rank <= 10
"""
