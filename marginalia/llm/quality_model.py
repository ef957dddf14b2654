"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, documents, slices
from .langid import held_out

#: Random features, ridge penalty per labelled row, the kernel's width in standard deviations, and the seed.
FEATURES = 192
RIDGE = 1e-4
WIDTH = 4.0
SEED = 7
#: Bins of raw scores that calibration counts, and the least score that counts as label 1.
BINS = 2000
LEAST_SCORE = 0.3
#: Vectors that one task of a tree of sums adds.
FAN_IN = 16

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_POINTS = b".,;:!?"
_PAIRED = b"\"'()[]{}"
_OTHER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _POINTS + _PAIRED)
STATISTICS = 24


def statistics(text: bytes) -> list[float]:
    """Numbers of a text that say nothing of its id, source, language or labels."""
    n, words = len(text), text.split()
    count = lambda chars: n - len(text.translate(None, chars))
    share = lambda x, of: x / of if of else 0.0
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    often = Counter(words)
    top = often.most_common(1)[0][1] if often else 0
    pairs = Counter(zip(words, words[1:]))
    equal = sum(c for (a, b), c in pairs.items() if a == b)
    ended = sum(w[-1] in _OTHER for w in words)
    mixed = sum(not w.isalpha() and w.isalnum() and not w.isdigit() for w in words)
    lengths = [len(w) for w in words]
    sizes = [len(x) for x in lines]
    mean = share(sum(lengths), len(words))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(n, 1)
    kinds = kinds[kinds > 0]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        mean,
        share(sum((x - mean) ** 2 for x in lengths), len(words)) ** 0.5,
        share(max(lengths, default=0), 20),
        share(upper, upper + lower),
        share(count(_DIGITS), n),
        share(count(_POINTS), n),
        share(count(_PAIRED), n),
        share(count(_OTHER), n),
        share(count(bytes(range(32))) - text.count(b"\n"), n),
        share(mixed, len(words)),
        share(count(bytes(range(128, 256))), n),
        share(len(often), len(words)),
        share(top, len(words)),
        share(len(pairs), max(1, len(words) - 1)),
        share(equal, len(words)),
        share(ended, len(words)),
        share(sum(x <= 3 for x in lengths), len(words)),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(share(sum(sizes), len(lines))),
        share(sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines), len(lines)),
        float(-(kinds * np.log2(kinds)).sum()),
        share(len(zlib.compress(text, 1)), n) if n else 1.0,
    ]


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(2)):
            found = [statistics(t) for t in as_bytes(batch.column(2).slice(start, stop - start))]
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "held_out", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id as text mod 5 is 0) and the statistics of every whole text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_state, "doc_id long, held_out boolean, stats array<double>")


class Model:
    """Scaling, random features, ridge weights and the calibration; a few hundred numbers a feature."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, seed: int, width: float):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(size=(len(mean), features)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def expand(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.cos(scaled @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.points), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, width: int, part) -> np.ndarray:
    """The sum over all rows of part(stats, labels), a vector of `width` numbers: summed in each partition, then as a tree, then here."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums, parts = rows.select("stats", "label").mapInArrow(partly, "sums binary"), rows.rdd.getNumPartitions()
    while parts > FAN_IN:  # a tree: no task, nor the driver, adds more than FAN_IN vectors at a time
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(again, "sums binary")
    return sum((np.frombuffer(r[0]) for r in sums.collect()), np.zeros(width))


def isotonic(counts: np.ndarray, goods: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of goods over counts by bin: adjacent violators are pooled, pools are joined by lines."""
    blocks: list[list[float]] = []
    for c, g, x in zip(counts, goods, at):
        if not c:
            continue
        blocks.append([c, g, x * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit_quality(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED, bins: int = BINS) -> Model | None:
    """A model of labels.quality from the statistics of labelled rows that aren't held out; None without such rows.

    All labelled rows count. Each partition sums its moments, its normal equations and its bins of scores; only sums of
    fixed size reach the driver. Of several labels of a document, and of rows that repeat it, each pair counts.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = cut(stats.where("not held_out").join(marked, "doc_id").select("stats", "label"))
    k = STATISTICS
    sums = _summed(rows, 2 * k + 1, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    n = sums[-1]
    if not n:
        return None
    mean = sums[:k] / n
    spread = np.sqrt(np.maximum(sums[k : 2 * k] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), features, seed, width)
    wide = features + 1

    def equations(x, y):
        z = model.expand(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    both = _summed(rows, wide * wide + wide, equations)
    model.weights = np.linalg.solve(both[: wide * wide].reshape(wide, wide) + ridge * n * np.eye(wide), both[wide * wide :])
    edges = np.linspace(-0.5, 1.5, bins + 1)

    def binned(x, y):
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins)])

    counted = _summed(rows, 2 * bins, binned)
    model.points = isotonic(counted[:bins], counted[bins:], (edges[:-1] + edges[1:]) / 2)
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The chance that each document's quality label is 1.

    Returns doc_id, held_out, score, predicted. Statistics of every whole text are computed once and checkpointed (24
    numbers a document); labels are joined to those, never to texts. Scores are calibrated ridge scores of random
    Fourier features of the statistics. Null text counts as empty and is scored like any other. Without labels every
    score is 0.5. Null ids hash as an empty string and learn nothing. Repeated rows each get their row; an empty table
    gives none. Other columns are ignored.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    model = fit_quality(stats, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = model.score(_matrix(batch.column(2))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= least_score).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_model(spark, sf_dir) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
