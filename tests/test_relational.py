"""Semantics of the relational operators that SQL does not share."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators import relational as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "B", None), (4, "ab", 5)], "id int, name string, n int")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "field,op,value,want",
    [
        ("name", "eq", None, [2]), ("name", "eq", "a", [1]), ("name", "not_eq", "a", [2, 3, 4]), ("name", "not_eq", None, [1, 3, 4]), ("n", "lt", 6, [1, 4]), ("n", "gte", 5, [1, 2, 4]),
        ("name", "in", ["a", None], [1, 2]), ("name", "in", "a", []), ("name", "contains", "B", [3, 4]), ("name", "starts_with", "A", [1, 4]), ("name", "exists", None, [1, 3, 4]),
    ],
)
def test_compare(rows, field, op, value, want):
    assert ids(R.where_cmp(rows, field, op, value)) == want


def test_unknown_comparison(rows):
    with pytest.raises(ValueError):
        R.where_cmp(rows, "n", "like", 1)


def test_joins_are_null_safe(spark, rows):
    other = spark.createDataFrame([(None, 1), ("a", 2)], "name string, v int")
    on = [("name", "eq", "name")]
    assert ids(R.join_records(rows, other, on)) == [1, 2]
    assert ids(R.join_records(rows, other, on, "anti")) == [3, 4]
    assert ids(R.join_records(rows, other, on, "semi")) == [1, 2]
    left = R.join_records(rows, other, on, "left")
    assert left.columns[-2:] == ["right_name", "right_v"] and left.count() == 4
    assert ids(R.join_records(rows, other, [*on, ("n", "not_eq", "v")])) == [1, 2]
    with pytest.raises(ValueError):
        R.join_records(rows, other, [("name", "not_eq", "name")])


def test_temporal(spark):
    df = spark.createDataFrame([(1, "1988", None), (2, "1988-05", "1990"), (3, None, None)], "id int, s string, e string")
    assert ids(R.temporal_filter(df, "s", "e", [("1988", "1989")])) == [1]
    assert ids(R.temporal_filter(df, "s", "e", [("1987", "1995"), ("1988-01", "1991")])) == [2]


def test_distinct_counts_nulls_once(spark, rows):
    twice = rows.unionByName(rows)
    assert R.count_distinct(twice, ["name", "n"]).first()[0] == 4
    assert R.exists_records(rows.where("false")).first()[0] is False


def test_ranks(rows):
    ranked = R.rank_records(rows, "n", "id").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in ranked] == [(2, 1), (1, 2), (4, 3), (3, 4)]
    assert [r.id for r in R.rank_records(rows, "n", "id", "asc", top=2).orderBy("rank").collect()] == [1, 4]
    first = R.sort_records(rows, [("n", "asc", "first")], "id").collect()
    assert [r.id for r in first] == [3, 1, 4, 2]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int"), spark.createDataFrame([(2,), (None,)], "id int")
    assert {r.id for r in R.compare_sets(a, b, "id", "overlap").collect()} == {2, None}
    assert {r.id for r in R.compare_sets(a, b, "id", "difference").collect()} == {1}
    assert R.compare_sets(a, b, "id", "values").first()[0] is False
    assert R.compare_sets(a, a, "id", "values").first()[0] is True
    assert tuple(R.compare_sets(a, b, "id", "populations").first()) == (3, 2)


def test_authority(spark):
    now = spark.createDataFrame([("x", 20, "old"), ("y", 10, "old")], "k string, rank int, v string")
    new = spark.createDataFrame([("x", 10, "new"), ("y", 10, "new"), ("z", 10, "new")], "k string, rank int, v string")
    assert sorted((r.k, r.v) for r in R.merge_by_authority(now, new, ["k"], "rank").collect()) == [("x", "old"), ("y", "new"), ("z", "new")]
    claims = spark.createDataFrame([("x", 3, "a"), ("x", 3, "a"), ("x", 1, "b"), ("y", 3, "a"), ("y", 3, "b")], "k string, rank int, v string")
    assert [tuple(r) for r in R.preferred_claims(claims, ["k"], "v", "rank").collect()] == [("x", "a", 3)]
    null = spark.createDataFrame([("x", "a", 3), ("x", None, 3), ("y", None, 2), ("y", "b", 1)], "k string, v string, rank int")
    assert [tuple(r) for r in R.preferred_claims(null, ["k"], "v", "rank").collect()] == [("y", None, 2)]


def test_scope(spark):
    df = spark.createDataFrame([("w1", 1), ("w2", 2)], "workspace_id string, n int")
    assert R.in_scope(df, {"workspace_id": "w1"}).count() == 1
    assert R.require_scope(df.where("n = 1"), {"workspace_id": "w1"}).count() == 1
    with pytest.raises(PySparkException):
        R.require_scope(df, {"workspace_id": "w1"}).collect()


def test_tombstones_twice(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = spark.createDataFrame([(1,)], "doc_id int")
    once = R.mark_deleted(docs, gone, "doc_id", F.lit("2026-01-01").cast("timestamp"))
    again = R.mark_deleted(once, gone, "doc_id", F.lit("2026-02-01").cast("timestamp"))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    assert R.tombstone(docs, gone, "doc_id").count() == 1


def test_evidence_union(spark):
    df = spark.createDataFrame([("a", ["e2", "e1"]), ("a", ["e1"]), ("b", [])], "k string, e array<string>")
    assert dict(map(tuple, R.collect_evidence(df, ["k"], "e").collect())) == {"a": ["e1", "e2"], "b": []}


def test_whole_ranking_with_other_columns(spark):
    """Far more rows than a range exchange samples, and columns that only one side of the plan would need."""
    rows = spark.range(0, 300_000, 1, 16).select("id", (F.col("id") * 7919 % 300_007).alias("score"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("payload"))
    ranked = R.rank_records(rows, "score", "id")
    order = ranked.orderBy("rank").select("rank", "score", "id", "payload").toPandas()
    assert order["rank"].tolist() == list(range(1, 300_001))
    want = sorted(((-(i * 7919 % 300_007), i) for i in range(300_000)))
    assert order["id"].tolist() == [i for _, i in want]
    assert (order["payload"] == "row " + order["id"].astype(str)).all()
