"""Whole jobs on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import build as B
from marginalia.sources import tables as S


def test_capabilities(spark):
    @B.capability("double")
    def double(df, field):
        return df.withColumn(field, F.col(field) * 2)

    df = spark.createDataFrame([(1,)], "n int")
    assert B.apply_capability(df, "double", field="n").first().n == 2
    with pytest.raises(ValueError):
        B.apply_capability(df, "none")
    with pytest.raises(ValueError):
        B.capability("double")(double)


def test_projections(spark, tmp_path):
    corpus = spark.createDataFrame([("w", "c1", "T", None, "ankara is here"), ("u", "c2", "T", "H", "izmir is there")], "workspace_id string, chunk_id string, title string, heading string, content string")
    B.build_projections(corpus, str(tmp_path / "p"), "g1", lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "h")
    postings, stats = S.read_index(spark, str(tmp_path / "p/sparse"), {"workspace_id": "w", "generation_id": "g1"})
    assert {r.term for r in postings.collect()} == {"ankara", "is", "here"} and stats.first().n == 1
    dense = spark.read.parquet(str(tmp_path / "p/dense")).where("workspace_id = 'u'").collect()
    assert [r.embedding for r in dense] == [[float(len("T\nH\nizmir is there")), 1.0]]


def test_mirror(spark):
    a = spark.createDataFrame([("x", ["u"], "text")], "artifact_id string, unit_ids array<string>, text string")
    u = spark.createDataFrame([("u", ["d"])], "unit_id string, document_ids array<string>")
    d = spark.createDataFrame([("d", "l")], "document_id string, logical_id string")
    row = B.mirror_vectors(a, u, d, lambda t: [[1.0] for _ in t], 1, "h", {"workspace_id": "w"}).first()
    assert (row.logical_ids, row.embedding, row.workspace_id) == (["l"], [1.0], "w")


def test_source_details(spark):
    chunks = spark.createDataFrame([("c", "d", "v", "l", 0), ("e", "d", "v", None, 4)], "chunk_id string, document_id string, version_id string, logical_id string, ordinal int")
    docs, versions = spark.createDataFrame([("d", "T")], "document_id string, title string"), spark.createDataFrame([("v", "f.txt")], "version_id string, source_filename string")
    logical = spark.createDataFrame([("l", "S.1", 2, 3)], "logical_id string, title string, page_start int, page_end int")
    got = {r.chunk_id: r.location for r in B.source_details(chunks, docs, versions, logical).collect()}
    assert got == {"c": "S.1, p. 2-3, passage 1", "e": "passage 5"}


def test_construct_goes_on(spark, tmp_path):
    chunks = spark.createDataFrame([("w", "v1", "c1", "Ada met Bey in 1988."), ("w", "v2", "c2", "broken")], "workspace_id string, version_id string, chunk_id string, content string")
    bundle = {
        "mentions": [{"mention_id": "m1", "text": "Ada", "entity_type": "person", "start_offset": 3}, {"mention_id": "m2", "text": "Bey", "entity_type": "person", "start_offset": 8}, {"mention_id": "m3", "text": "Nobody", "entity_type": "person", "start_offset": 0}],
        "relations": [{"relation_id": "r1", "source_mention": "m1", "target_mention": "m2", "relation_type": "met"}, {"relation_id": "r2", "source_mention": "m1", "target_mention": "m3", "relation_type": "met"}],
        "events": [{"event_id": "e1", "event_type": "meeting", "participants": [{"mention_id": "m1", "role": "who"}, {"mention_id": "m3", "role": "who"}], "temporal_ids": ["t1", "t9"]}],
        "temporals": [{"temporal_id": "t1", "original_text": "1988", "normalized_start": "1988", "normalized_end": None, "precision": "year"}, {"temporal_id": "t2", "original_text": "x", "normalized_start": "1990", "normalized_end": "1980", "precision": "year"}],
        "claims": [{"claim_id": "k1", "subject_mention": "m2", "predicate": "met", "value": "Ada"}],
    }
    text = json.dumps(bundle)

    def extractor(content):
        if content == "broken":
            raise RuntimeError
        return text

    made = B.construct(chunks, extractor, str(tmp_path), "g1")
    count = {k: v.count() for k, v in made.items()}
    assert count == {"extraction": 2, "mentions": 2, "identity": 2, "entities": 2, "relations": 1, "temporals": 1, "participants": 1, "event_times": 1, "claims": 1, "rejects": 1}
    assert {r.start_offset for r in made["mentions"].collect()} == {0, 8}

    def never(content):
        raise AssertionError

    again = B.construct(chunks, never, str(tmp_path), "g1")
    assert {k: v.count() for k, v in again.items()} == count
