"""The store: upserts, retries, failures, several tables at once, replaced scopes."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import knowledge as K
from marginalia.sources import tables as S
from marginalia.sources.store import Store


def rows(spark, start, stop, v):
    return spark.range(start, stop).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "even").alias("scope"), F.lit(v).alias("v"))


def test_upserts_and_retries(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.change("w", 0, {"t": (rows(spark, 0, 100, "a"), ["k"])})
    assert store.change("w", 1, {"t": (rows(spark, 98, 103, "b"), ["k"])})
    want = {i: "b" if i >= 98 else "a" for i in range(103)}
    assert {r.k: r.v for r in store.read("t").collect()} == want
    before = store.manifest()
    assert not store.change("w", 1, {"t": (rows(spark, 0, 5, "lost"), ["k"])}) and not store.change("w", 0, {"t": (rows(spark, 0, 5, "lost"), ["k"])})
    assert store.manifest() == before and {r.k: r.v for r in store.read("t").collect()} == want
    assert {r.v for r in store.read("t", 1).collect()} == {"a"} and store.read("t", 1).count() == 100
    assert store.change("w", 2, {"t": (rows(spark, 5, 6, "c"), ["k"])})
    after = store.manifest()["tables"]["t"]["buckets"]
    assert sum(after[b] != f for b, f in before["tables"]["t"]["buckets"].items()) == 1  # one bucket was rewritten
    assert store.vacuum() > 0 and store.versions() == [3] and store.read("t").count() == 103
    with pytest.raises(ValueError):
        store.read("other")


def test_what_fails_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.change("w", 0, {"t": (rows(spark, 0, 10, "a"), ["k"]), "u": (rows(spark, 0, 3, "a"), ["k"])})
    broken = rows(spark, 0, 5, "b").withColumn("v", F.when(F.col("k") < 3, F.col("v")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        store.change("w", 1, {"u": (rows(spark, 0, 9, "b"), ["k"]), "t": (broken, ["k"])})
    with pytest.raises(ValueError, match="repeated"):
        store.change("w", 1, {"t": (rows(spark, 0, 2, "b").unionByName(rows(spark, 1, 2, "c")), ["k"])})
    assert {r.v for r in store.read("t").collect()} == {r.v for r in store.read("u").collect()} == {"a"} and store.versions() == [1]
    assert store.change("w", 1, {"u": (rows(spark, 0, 9, "b"), ["k"])}) and store.read("u").count() == 9 and store.read("t").count() == 10


def test_nulls_and_replaced_scopes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.change("w", 0, {"t": (rows(spark, 0, 20, "a"), ["scope", "k"])})
    store.change("w", 1, {"t": (rows(spark, 1, 2, "b"), ["scope", "k"])})  # a null in the key
    assert {r.k: r.v for r in store.read("t").collect()} == {i: "b" if i == 1 else "a" for i in range(20)}
    store.change("w", 2, {"t": (rows(spark, 40, 41, "c"), ["scope", "k"])}, {"t": F.col("scope") == "even"})
    assert sorted(r.k for r in store.read("t").collect()) == [*range(1, 20, 2), 40]
    store.change("w", 3, {"t": (rows(spark, 0, 0, "c"), ["scope", "k"])}, {"t": F.lit(True)})
    assert store.read("t").count() == 0


def test_vectors_and_layers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("w", "c1", "h", [1.0, 2.0], 1), ("w", "c1", "h", [3.0, 4.0], 2), ("w", "c2", "h", [0.0, 1.0], 1)], "workspace_id string, chunk_id string, config_hash string, embedding array<double>, version int")
    for n in (0, 1):
        S.store_vectors(store, n, df, 2, "h", ["workspace_id"], ["chunk_id"])
    S.store_vectors(store, 2, df.where("chunk_id = 'c2'").withColumn("version", F.lit(5)), 2, "h", ["workspace_id"], ["chunk_id"])
    assert {(r.chunk_id, r.version) for r in store.read("vectors").collect()} == {("c1", 2), ("c2", 5)}
    with pytest.raises(Exception, match="not of 3"):
        S.store_vectors(store, 3, df, 3, "h", ["workspace_id"], ["chunk_id"])
    nodes = spark.createDataFrame([("a", "g"), ("b", "g")], "node string, generation_id string")
    edges = spark.createDataFrame([("e", "a", "b")], "edge_id string, source string, target string")
    K.store_extracted(store, 0, nodes, edges, "g")
    K.store_extracted(store, 1, nodes.withColumn("generation_id", F.lit("h")), edges, "h")
    K.store_extracted(store, 2, nodes.where("node = 'a'"), edges.where("false"), "g")
    assert {(r.node, r.generation_id) for r in store.read("nodes").collect()} == {("a", "g"), ("a", "h"), ("b", "h")}
    assert [r.generation_id for r in store.read("edges").collect()] == ["h"]
    with pytest.raises(ValueError, match="missing_end"):
        K.store_extracted(store, 3, nodes.where("node = 'a'"), edges, "g")
    assert store.read("vectors").count() == 2
