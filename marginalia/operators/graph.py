"""Graph operators over edge tables: lookups, bounded traversal, event paths, conflicts, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.relational import paired_classes, paired_members
from marginalia.sources.session import materialize

MOST_HOPS = 10


def resolve_endpoints(edges: DataFrame, entities: DataFrame, aliases: list[str], kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with source_id and target_id, unmatched edges): free-text ends of edges (source, target) found by any alias column.

    entities has entity_id and the alias columns; of entities that share an alias the least id is taken.
    """
    named = entities.select("entity_id", F.explode(F.array_compact(F.array(*[F.lower(F.trim(F.col(a).cast("string"))) for a in ["entity_id", *aliases]]))).alias("alias"))
    one = named.groupBy("alias").agg(F.min("entity_id").alias("entity_id"))
    end = lambda side: one.select(F.col("alias").alias(f"_{side}"), F.col("entity_id").alias(f"{side}_id"))
    low = edges.withColumns({f"_{s}": F.lower(F.trim(F.col(s).cast("string"))) for s in ("source", "target")})
    joined = low.join(end("source"), "_source", "left").join(end("target"), "_target", "left").drop("_source", "_target")
    ok = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    return joined.where(ok), joined.where(~ok)


def lookup_entities(entities: DataFrame, ids: DataFrame, evidence: DataFrame, generation: str) -> DataFrame:
    """Entities by id in one generation, with the ids of their evidence."""
    held = entities.where(F.col("generation_id") == generation).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    found = evidence.groupBy("entity_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))
    return held.join(found, "entity_id", "left")


def traverse(edges: DataFrame, starts: DataFrame, direction: str = "outgoing", low: int = 1, high: int = 1, relation: str | None = None) -> DataFrame:
    """Paths of low to high hops from each start: start, nodes, edges, hops. No edge is twice in a path.

    edges: edge_id, source, target, relation; starts: node. A hop is one join on the frontier's end; a frontier that another
    hop follows is written first, so each hop is computed once. incoming follows edges backwards, either both ways.
    """
    if not 0 <= low <= high <= MOST_HOPS:
        raise ValueError(f"hops must be 0 <= low <= high <= {MOST_HOPS}")
    chosen = edges.where(F.col("relation") == relation) if relation else edges
    out = chosen.select("edge_id", F.col("source").alias("_from"), F.col("target").alias("_to"))
    back = chosen.select("edge_id", F.col("target").alias("_from"), F.col("source").alias("_to"))
    steps = {"outgoing": out, "incoming": back, "either": out.unionByName(back.where("_from <> _to"))}[direction]
    kind = chosen.schema["edge_id"].dataType
    frontier = starts.select(F.col("node").alias("start"), F.array("node").alias("nodes"), F.array().cast(f"array<{kind.simpleString()}>").alias("edges"), F.lit(0).alias("hops"))
    found = frontier if low == 0 else None
    for hop in range(1, high + 1):
        joined = frontier.withColumn("_from", F.element_at("nodes", -1)).join(steps, "_from").where(~F.array_contains("edges", F.col("edge_id")))
        frontier = joined.select("start", F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), F.lit(hop).alias("hops"))
        if hop < high:
            frontier = materialize(frontier)
        if hop >= low:
            found = frontier if found is None else found.unionByName(frontier)
    return found


def reach(edges: DataFrame, starts: DataFrame, direction: str = "outgoing", most: int | None = None, relation: str | None = None) -> DataFrame:
    """(start, node, hops): every other node that a start leads to, with the least number of hops, up to `most` (None: all).

    A fixpoint without paths: each round follows the edges of what the round before has found, and what was reached before
    falls away, so that cycles end and a node is followed once. Starts with the same neighbours reach the same nodes, but for
    themselves: they are followed as one class, and only the result has a row for each of them. A round's new rows are
    written; rounds are as many as the farthest node is away.
    """
    chosen = edges.where(F.col("relation") == relation) if relation else edges
    out = chosen.select(F.col("source").alias("_from"), F.col("target").alias("node"))
    back = chosen.select(F.col("target").alias("_from"), F.col("source").alias("node"))
    steps = materialize({"outgoing": out, "incoming": back, "either": out.unionByName(back)}[direction].where("_from <> node").distinct())
    first = materialize(starts.select(F.col("node").alias("start")).distinct().join(steps, F.col("start") == F.col("_from")).select("start", "node"))
    # starts of one class have the same neighbours: the count and 128 bits of their hashes
    marks = first.groupBy("start").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("b"), "node")).alias("_b"))
    least = marks.groupBy("_n", "_a", "_b").agg(F.min("start").alias("class"))
    classes = materialize(marks.join(least, ["_n", "_a", "_b"]).select("class", "start"))
    fresh = materialize(first.join(classes.where("class = start"), "start").select("class", "node", F.lit(1).alias("hops")))
    rounds, hop = [], 0
    while most is None or hop < most:
        hop += 1
        if hop > 1:
            found = rounds[-1].select("class", F.col("node").alias("_from")).join(steps, "_from").select("class", "node").distinct()
            fresh = materialize(found.join(_stacked(rounds).select("class", "node"), ["class", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    if not rounds:
        return first.select("start", "node", F.lit(1).alias("hops")).limit(0)
    whole = _stacked(rounds)
    if classes.where("class <> start").isEmpty():
        met = whole.withColumnRenamed("class", "start")
    else:
        met = paired_members(paired_classes(classes, whole, ["class"], "start", "node"), "start", "node")
    return met.where("start <> node").select("start", "node", "hops")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def event_paths(events: DataFrame, participants: DataFrame, times: DataFrame, ids: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events in which the entities take part, with the role and, if known, the time; a given range asks for a time inside it.

    events: event_id, event_type; participants: event_id, entity_id, role; times: event_id, normalized_start, normalized_end.
    """
    mine = participants.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    joined = mine.join(events, "event_id").join(times, "event_id", "left")
    if start or end:
        last = F.coalesce("normalized_end", "normalized_start")
        held = F.col("normalized_start").isNotNull()
        if start:
            held = held & (F.col("normalized_start") >= start)
        if end:
            held = held & (last <= end)
        joined = joined.where(held)
    return joined.select("entity_id", "role", "event_id", "event_type", "normalized_start", "normalized_end")


def conflicting_classes(claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The conflicts of claim_conflicts() as pairs of classes: arrays of claims of one subject, predicate, value and evidence.

    Of two classes one alone is on the left, that of the lesser value, so that what is computed here is computed once for all
    their pairs; conflicting_members() makes the pairs.
    """
    # only keys with two values are joined with themselves
    keys = ["subject_id", "predicate"]
    split = claims.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b")).where("_a <> _b").select(*keys)
    held = claims.select("claim_id", *keys, "value").join(split, keys, "left_semi")
    if evidence is not None:
        held = held.join(_evidence_ids(evidence), "claim_id", "left")
    more = [] if evidence is None else ["ids"]
    side = lambda name: held.select(*keys, F.col("claim_id").alias(name), F.col("value").alias(f"{name}_value"), *[F.col(c).alias(f"{name}_evidence") for c in more])
    met = paired_classes(side("left"), side("right"), keys, "left", "right").where("left_value < right_value or left_value is null and right_value is not null")
    if evidence is not None:
        met = met.withColumn("evidence_ids", _united("left_evidence", "right_evidence")).drop("left_evidence", "right_evidence")
    return met


def conflicting_members(classes: DataFrame) -> DataFrame:
    """The pairs of conflicting_classes(): the lesser claim is on the left, with its value."""
    pairs = paired_members(classes, "left", "right").where("left <> right")
    turned = F.col("left") > F.col("right")
    value = lambda one, other: F.when(turned, F.col(f"{other}_value")).otherwise(F.col(f"{one}_value"))
    return pairs.withColumns({"left": F.least("left", "right"), "right": F.greatest("left", "right"), "left_value": value("left", "right"), "right_value": value("right", "left")})


def claim_conflicts(claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(left, right) claims of one subject and predicate with different values, each pair once. claims: claim_id, subject_id, predicate, value.

    With evidence (claim_id, evidence_id) a pair has the evidence ids of both sides, as conflict_report() finds them: they are
    united once for claims of one value and evidence, and no pair is shuffled.
    """
    return conflicting_members(conflicting_classes(claims, evidence))


def contested_keys(claims: DataFrame) -> DataFrame:
    """The same without pairs: each subject and predicate with more than one value, and how many claims and values it has."""
    grouped = claims.groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("value").alias("n_values"))
    return grouped.where("n_values > 1")


def _evidence_ids(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("claim_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("ids"))


def _united(left: str, right: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.sort_array(F.array_union(F.coalesce(left, empty), F.coalesce(right, empty)))


def conflict_report(conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Conflicts with the evidence ids of both sides. evidence: claim_id, evidence_id.

    For conflicts that are given; claim_conflicts() adds the same to those it finds without a shuffle of pairs.
    """
    ids = _evidence_ids(evidence)
    side = lambda name: ids.select(F.col("claim_id").alias(name), F.col("ids").alias(f"{name}_evidence"))
    joined = conflicts.join(side("left"), "left", "left").join(side("right"), "right", "left")
    return joined.withColumn("evidence_ids", _united("left_evidence", "right_evidence"))


def artifact_evidence(artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of artifacts (artifact_id, evidence_ids)."""
    return artifacts.select("artifact_id", F.explode("evidence_ids").alias("evidence_id")).distinct().join(evidence, "evidence_id")


def evidence_chain(evidence: DataFrame, chunks: DataFrame, logical: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence with the chunk, section, version and document that it lies in; a missing link leaves the row out."""
    return evidence.join(chunks, "chunk_id").join(logical, "logical_id").join(versions, "version_id").join(documents, "document_id")


def ambiguity(resolved: DataFrame) -> DataFrame:
    """References (reference, entity_id) with two or more candidates."""
    counted = resolved.select("reference", "entity_id").distinct().groupBy("reference")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("entity_id")).alias("candidates")).where("n > 1")


def graph_sample(nodes: DataFrame, edges: DataFrame, n_nodes: int = 150, n_edges: int = 300) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and of the edges between them the first by id."""
    kept = nodes.orderBy("node").limit(n_nodes)
    ends = kept.select("node")
    inside = edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, inside.orderBy("edge_id").limit(n_edges)
