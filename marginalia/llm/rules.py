"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices

#: Hash buckets of the two multinomials, bytes of an n-gram, and the most labelled rows that form the trusted target.
BUCKET_BITS = 16
GRAM = 4
TARGET_ROWS = 100_000
#: A text passes at this mean log ratio (nats per n-gram) or above.
LEAST_RATIO = -0.25
#: Counts added to each bucket, and the steps of a nat in which ratios are summed, so that sums don't depend on their order.
PRIOR = 1.0
STEPS = 1 << 16

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
WINDOW = 5


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = text.split()
    chars = len(text.translate(None, BLANK + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(BLANK)]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _grams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, in order, and how many each text has; none crosses two texts."""
    whole = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8).astype(np.uint32)
    n = len(whole) - GRAM
    code = whole[:n].copy()
    for i in range(1, GRAM):
        code |= whole[i : n + i] << np.uint32(8 * i)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(sizes - GRAM + 1, 0)
    ends = np.cumsum(sizes)
    inside = np.ones(n, bool)
    for i in range(1, GRAM):
        inside[np.maximum(ends - i, ends - sizes)[sizes > 0]] = False
    return bucket[inside], counts


def _count(ids: np.ndarray, bits: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            doc = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            trusted = np.isin(doc, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for start, stop in slices(batch.column(1)):
                texts = as_bytes(batch.column(1).slice(start, stop - start))
                bucket, counts = _grams(texts, bits)
                raw += np.bincount(bucket, minlength=len(raw))
                if trusted[start:stop].any():
                    target += np.bincount(bucket[np.repeat(trusted[start:stop], counts)], minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return counted


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BUCKET_BITS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p(bucket | trusted target) - log p(bucket | raw corpus) of every bucket, in steps.

    The raw multinomial counts every n-gram of every document. The trusted target is the documents that labels mark as
    good (quality 1): all of them up to `target_rows`, beyond that those with the least hash of their id; their ids are
    the only rows that reach the driver, besides one row for each bucket. Without labels all ratios are 0.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    ids = np.array([r[0] for r in good.collect()], np.int64)
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count(ids, bits), "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(1 << bits, np.int64)
    ratio = np.log((target + PRIOR) / (target.sum() + PRIOR * len(target))) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * len(raw)))
    return np.round(ratio * STEPS).astype(np.int64)


def _judge(ratio: np.ndarray, bits: int, least: float):
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()), ("kept", pa.bool_())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                texts = as_bytes(batch.column(1).slice(start, stop - start))
                bucket, counts = _grams(texts, bits)
                total = np.concatenate([[0], np.cumsum(ratio[bucket])])
                ends = np.cumsum(counts)
                mean = (total[ends] - total[ends - counts]) / STEPS / np.maximum(counts, 1)
                base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                columns = [batch.column(0).slice(start, stop - start), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= least))]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return judged


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BUCKET_BITS, least_ratio: float = LEAST_RATIO, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Base counts, the length-normalised log-likelihood ratio and the verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept. A document is
    kept if the base rules pass and its mean ratio of the trusted target to the raw corpus, over its hashed 4-byte
    n-grams, is `least_ratio` or more. Both passes go over whole texts, without a shuffle of texts: what tasks send is
    one count for each of the 2**bits buckets, whatever the input. Ratios are summed as whole steps, so that a document
    gets the same verdict in any partitioning.

    Null text counts as empty, fails the base rules and has ratio 0, as have texts of under 4 bytes. Repeated rows each
    get their row. An empty table gives no rows; empty labels leave the base rules to decide. Other columns are ignored.
    """
    ratio = fit_ratio(docs, labels, id_col, text_col, bits, target_rows)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_judge(ratio, bits, least_ratio), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean")


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
