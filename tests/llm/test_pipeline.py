"""The pipeline's stages, each on its own input."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from marginalia.llm import langid

from .helpers import SCHEMA, components, frame, odd_rows
from .test_operators import _languages_by_hand, _mix

ROWS = odd_rows(7, 80)
SHORT = [(i, None if t is None else t[:150], *r) for i, t, *r in ROWS if i < 60]


def _ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark):
    docs = frame(spark, ROWS).cache()
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language ID", "exact dedup", "MinHash near-dedup", "mix", "byte-level BPE"]

    kept = stage["language ID"](spark, docs, "")
    rejected = {r.doc_id for r in langid.identify_languages(docs).collect() if r.lang_pred == "und" or r.score < corpus_pipeline.LEAST_SHARE}
    assert kept.columns == docs.columns and _ids(kept) == sorted(i for i, *_ in ROWS if i not in rejected)

    by_hand = _languages_by_hand([(i, t, k, None, None) for i, t, k, *_ in SHORT])
    kept = stage["language ID"](spark, frame(spark, SHORT), "")
    assert _ids(kept) == sorted(i for i, *_ in SHORT if by_hand[i][0] != "und" and by_hand[i][1] >= corpus_pipeline.LEAST_SHARE)

    kept = stage["exact dedup"](spark, docs, "")
    last = {t or "": max(i for i, u, *_ in ROWS if (u or "") == (t or "")) for _, t, *_ in ROWS}
    assert kept.columns == docs.columns and _ids(kept) == sorted(set(last.values()))

    kept = stage["MinHash near-dedup"](spark, docs, "")
    want = {i for i, (_, root) in components(ROWS, 5).items() if i == root}
    assert kept.columns == docs.columns and _ids(kept) == sorted(want)

    mixed = stage["mix"](spark, docs, "")
    size, of, target = _mix(ROWS)
    took = Counter(r.doc_id for r in mixed.collect())
    times = Counter(i for i, *_ in ROWS)
    for s in of:  # by hand: whole copies of every document, then what Pareto order takes
        own = {r[0]: n for r, n in zip(ROWS, size) if r[3] == s and n}
        whole = int(target[s] // of[s]) if of[s] else 0
        words = sum(n * took[i] for i, n in own.items())
        assert abs(words - target[s]) <= max(own.values(), default=0) / 2 + 1
        assert all(whole * times[i] <= took[i] <= (whole + 1) * times[i] for i in own)
    assert mixed.columns == docs.columns and set(took) <= {r[0] for r, n in zip(ROWS, size) if n}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = stage["byte-level BPE"](spark, docs, "").collect()
    want = sorted((i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in coded) == want


def test_stages_of_odd_tables(spark):
    """Empty tables stay empty; null ids, repeated rows, ids of two texts and null texts are what the docstrings say."""
    stage = dict(corpus_pipeline.STAGES)
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, spark.createDataFrame([], SCHEMA), "").count() == 0, name
    text = "the house over the night and nothing else that of it " * 3
    rows = [(None, text, "en", "a", "x"), (None, text, "en", "a", "y"), (1, text, "en", "a", "x"), (1, text, "en", "a", "x"), (1, "other words of the house", "en", "a", None), (2, None, "en", None, None), (2, None, None, None, None), (4, text + " more", "en", "a", None)]
    docs = frame(spark, rows).cache()
    tell = lambda df: sorted(((r.doc_id or 0, len(r.text or "")) for r in df.collect()))
    n = len(text)
    assert tell(stage["language ID"](spark, docs, "")) == [(0, n), (0, n), (1, 24), (1, n), (1, n), (4, n + 5)]
    assert tell(stage["exact dedup"](spark, docs, "")) == [(1, 24), (1, n), (2, 0), (4, n + 5)]
    assert tell(stage["MinHash near-dedup"](spark, docs, "")) == [(0, n), (1, 24), (1, n), (2, 0)]
    mixed = stage["mix"](spark, docs, "").collect()
    assert {r.doc_id for r in mixed} <= {None, 1, 4} and len(mixed) <= 12
    assert stage["byte-level BPE"](spark, docs, "").count() == 8


def test_run(spark, tmp_path):
    """The run is its stages in turn."""
    frame(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, run) in enumerate(corpus_pipeline.STAGES):
        run(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
    assert docs.count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
