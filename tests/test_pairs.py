"""Operators whose results are pairs: dealt evenly, every pair once."""

from pyspark.sql import functions as F

from marginalia.operators import graph as G
from marginalia.operators import identity as I
from marginalia.operators import knowledge as K
from marginalia.operators.relational import paired_classes, paired_members, short_classes
from marginalia.plans import knowledge


def test_every_pair_once(spark):
    left = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.col("id") % 2).alias("x"))
    right = spark.range(150).select((F.col("id") % 4).alias("k"), F.col("id").cast("string").alias("b"))
    got = paired_classes(left, right, ["k"], "a", "b", 7).withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).collect()
    want = [(a, a % 2, str(b)) for a in range(100) for b in range(150) if a % 3 == b % 4]
    assert sorted((r.a, r.x, r.b) for r in got) == sorted(want)


def test_conflicts_of_one_subject_are_dealt_to_tasks(spark):
    claims = spark.range(9000).select(F.col("id").alias("claim_id"), F.lit("s").alias("subject_id"), F.lit("p").alias("predicate"), (F.col("id") % 50 == 0).cast("string").alias("value"))
    sizes = [r["count"] for r in G.claim_conflicts(claims).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 180 * 8820 and max(sizes) < sum(sizes) / 2


def test_conflicts_with_evidence(spark):
    claims = spark.createDataFrame([(i, "s", "p", v) for i, v in enumerate("abcab")], "claim_id int, subject_id string, predicate string, value string")
    evidence = spark.createDataFrame([(0, "e1"), (0, "e2"), (1, "e2"), (3, "e0")], "claim_id int, evidence_id string")
    want = G.conflict_report(G.claim_conflicts(claims), evidence).select("left", "right", "evidence_ids").collect()
    assert sorted(G.claim_conflicts(claims, evidence).select("left", "right", "evidence_ids").collect()) == sorted(want) and len(want) == 8


def test_text_of_evidence_is_made_once_a_class(spark, data):
    plan = knowledge.conflict_report(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate explode(left") < plan.index("concat_ws")


def test_classes_conflict_in_one_order_alone(spark):
    claims = spark.createDataFrame([(i, "s", "p", v) for i, v in enumerate(["b", "a", None, "b", "c", None, "a"])] + [(3, "s", "p", "d")], "claim_id int, subject_id string, predicate string, value string")
    rows = [(r.claim_id, r.value) for r in claims.collect()]
    want = sorted(str((a, b, x, y)) for a, x in rows for b, y in rows if a < b and x != y)
    assert sorted(str((r.left, r.right, r.left_value, r.right_value)) for r in G.claim_conflicts(claims).collect()) == want
    met = G.conflicting_classes(claims).selectExpr("sum(size(left) * size(right))").first()[0]
    assert met == len(want) + 1  # the claim of two values, which is no pair


def test_few_pairs_are_made_of_a_row(spark):
    left = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    right = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("b"))
    classes = paired_classes(left, right, ["k"], "a", "b")
    assert short_classes(classes, "b").selectExpr("max(size(a) * size(b))").first()[0] <= 1024
    assert paired_members(classes, "a", "b").distinct().count() == 3000 * 3000


def _identities(spark):
    mentions = spark.createDataFrame([("m1", "Ann", "p"), ("m2", "ann", "p"), ("m2", "Bob", "p"), ("m2", "bob ", "p"), ("m3", "Bob", "q"), ("m4", None, "p")], "mention_id string, text string, entity_type string")
    entities = spark.createDataFrame([("e1", "p", "Ann"), ("e2", "p", "Bob"), ("e3", "q", "Bob")], "entity_id string, entity_type string, display_name string")
    aliases = spark.createDataFrame([("e1", "Bob", True), ("e2", "Ann", False)], "entity_id string, value string, active boolean")
    resolved = spark.createDataFrame([("e1", 1, 1), ("e1", 2, 2), ("e3", 1, 1)], "entity_id string, evidence_id int, version_id int")
    return mentions, entities, aliases, resolved


def test_candidates_of_a_mention_with_two_names(spark):
    got = sorted(tuple(r) for r in K.identity_candidates(*_identities(spark)).collect())
    assert got == [("m1", "e1", 2, 2), ("m2", "e1", 2, 2), ("m2", "e2", 0, 0), ("m3", "e3", 1, 1)]


def test_resolution_by_name_needs_no_pairs(spark):
    given = _identities(spark)
    want = K.resolve_mentions(given[0], K.identity_candidates(*given)).collect()
    assert sorted(K.resolve_by_name(*given).collect()) == sorted(want) and len(want) == 6


def test_starts_with_the_same_neighbours_are_followed_once(spark, monkeypatch):
    written = []
    kept = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: written.append(kept(df)) or written[-1])
    edges = spark.createDataFrame([(f"s{i}", f"n{i % 2}", "r") for i in range(200)], "source string, target string, relation string")
    got = G.reach(edges, edges.select(F.col("source").alias("node")), "either", 2)
    counted = {(r.hops): r["count"] for r in got.groupBy("hops").count().collect()}
    assert counted == {1: 200, 2: 200 * 99} and got.distinct().count() == 200 * 100
    assert max(df.count() for df in written) <= 400


def test_replay_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    kept = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    entities = spark.range(40).select(F.col("id").alias("entity_id"), F.lit("t").alias("entity_type"), F.lit("active").alias("status"))
    merges = spark.range(1, 40).select(F.col("id").alias("seq"), F.col("id").alias("source_id"), F.floor(F.col("id") / 2).alias("target_id"))
    none = spark.createDataFrame([], "entity_id long, value string")
    marked, _, _, operations = I.merge_entities(entities, none, none, merges)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (marked, operations, I.merge_history(entities, merges))]
    assert operations.where("applied").count() == 39 and len(plans) > 20
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
