"""Queries of graph, knowledge, evidence and log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import evidence as E
from marginalia.operators import graph as G
from marginalia.operators import identity as I
from marginalia.operators import knowledge as K
from marginalia.operators import logs as L


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark, d):
    """Customers and suppliers to their nation, nations to their region."""
    edge = lambda df, a, k, b, m, rel: df.select(F.concat(F.lit(f"{rel}:"), F.col(k).cast("string")).alias("edge_id"), F.concat(F.lit(a), F.col(k).cast("string")).alias("source"), F.concat(F.lit(b), F.col(m).cast("string")).alias("target"), F.lit(rel).alias("relation"))
    c = edge(_t(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey", "lives_in")
    s = edge(_t(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "works_in")
    return c.unionByName(s).unionByName(edge(_t(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey", "part_of"))


def _paths(df):
    return df.select("start", F.concat_ws(">", "nodes").alias("nodes"), F.concat_ws(",", "edges").alias("edges"), "hops")


def traverse_out(spark, d):
    edges = _edges(spark, d)
    return _paths(G.traverse(edges, edges.where("relation = 'works_in'").select(F.col("source").alias("node")), "outgoing", 1, 1))


def traverse_in(spark, d):
    edges = _edges(spark, d)
    return _paths(G.traverse(edges, edges.where("relation = 'part_of'").select(F.col("target").alias("node")).distinct(), "incoming", 2, 2))


def traverse_multi_hop(spark, d):
    edges = _edges(spark, d)
    return _paths(G.traverse(edges, edges.where("relation = 'lives_in'").select(F.col("source").alias("node")), "outgoing", 1, 3))


def reached(spark, d):
    """What suppliers reach by their nation, in two hops."""
    edges = _edges(spark, d)
    return G.reach(edges, edges.where("relation = 'works_in'").select(F.col("source").alias("node")), "either", 2, "works_in")


def reached_in_cycles(spark, d):
    """All that each part leads to, by two edges a part within its block of sixteen, which go round."""
    k = F.col("p_partkey").cast("long")
    within = lambda x: (F.floor(k / 16) * 16 + x % 16)
    edge = lambda target: _t(spark, d, "part").select(k.alias("source"), target.alias("target"), F.lit("r").alias("relation"))
    edges = edge(within(k * 5 + 3)).unionByName(edge(within(k * 2)))
    return G.reach(edges, _t(spark, d, "part").select(k.alias("node")))


def resolve_endpoints(spark, d):
    """Nations' regions by name, in capitals, or by number."""
    nation = _t(spark, d, "nation")
    region = _t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity_id"), "r_name", F.col("r_regionkey").alias("number"))
    names = nation.join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = names.select(F.upper("r_name").alias("source"), F.when(F.col("n_nationkey") < 20, F.col("n_regionkey").cast("string")).otherwise("elsewhere").alias("target"), F.col("n_nationkey").alias("edge"))
    ok, lost = G.resolve_endpoints(edges, region, ["r_name", "number"])
    return ok.select("edge", "source_id", "target_id").unionByName(lost.select("edge", "source_id", "target_id"))


def event_paths(spark, d):
    orders = _t(spark, d, "orders")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"))
    people = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), F.lit("buyer").alias("role"))
    people = people.unionByName(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"), F.lit("seller").alias("role")).distinct())
    times = orders.select(F.col("o_orderkey").alias("event_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("normalized_start"), F.lit(None).cast("string").alias("normalized_end"))
    rich = _t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity_id"))
    return G.event_paths(events, people, times, rich, "1995", "1996").select("entity_id", "role", "event_id", "event_type", "normalized_start")


def _claims(spark, d):
    part = _t(spark, d, "part")
    return part.select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("subject_id"), F.lit("brand").alias("predicate"), F.col("p_brand").alias("value"))


def claim_conflicts(spark, d):
    return G.claim_conflicts(_claims(spark, d)).select("subject_id", "left", "right")


def contested_claims(spark, d):
    claims = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.lit("supplied_by").alias("predicate"), F.col("l_suppkey").alias("value"))
    return G.contested_keys(claims).select("subject_id", "n_claims", "n_values")


def conflict_report(spark, d):
    evidence = _t(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_type").alias("evidence_id"))
    classes = G.conflicting_classes(_claims(spark, d), evidence)
    return G.conflicting_members(classes.withColumn("evidence_ids", F.concat_ws(",", "evidence_ids"))).select("left", "right", "evidence_ids")


def ambiguous_names(spark, d):
    found = G.ambiguity(_t(spark, d, "part").select(F.col("p_name").alias("reference"), F.col("p_partkey").alias("entity_id")))
    return found.select("reference", "n", F.concat_ws(",", F.transform("candidates", lambda x: x.cast("string"))).alias("candidates"))


def _identity(spark, d):
    part = _t(spark, d, "part")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("text"), F.lit("product").alias("entity_type"), F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("version_id"))
    entities = part.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("product").alias("entity_type"), F.col("p_name").alias("display_name"))
    aliases = part.where("p_size > 45").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_type").alias("value"), F.lit(True).alias("active"))
    return mentions, entities, aliases


def _resolved(spark, d):
    """Lines as mentions that have been resolved to parts before, for two thirds of the parts."""
    return _t(spark, d, "lineitem").where("l_partkey % 3 > 0 AND l_linenumber < 3").select(F.col("l_partkey").cast("string").alias("entity_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), (F.col("l_suppkey") % 4).alias("version_id"))


def identity_candidates(spark, d):
    return K.identity_candidates(*_identity(spark, d), _resolved(spark, d), ascii_only=True)


def resolve_mentions(spark, d):
    mentions, entities, aliases = _identity(spark, d)
    return K.resolve_by_name(mentions, entities, aliases, _resolved(spark, d), True).select("mention_id", "decision", F.when(F.col("decision") == "linked", F.col("entity_id")).alias("entity_id"))


def build_entities(spark, d):
    part = _t(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.lit("product").alias("entity_type"), F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("text"))
    return K.build_entities(part).select("entity_id", "display_name", "n_mentions", F.size("aliases").alias("n_aliases"))


def link_mentions(spark, d):
    """Parts by name within their size's half, or any for every third."""
    part = _t(spark, d, "part").withColumn("entity_type", F.when(F.col("p_size") > 25, "large").otherwise("small"))
    catalog = part.select(F.col("p_partkey").alias("entity_id"), "entity_type", F.col("p_name").alias("display_name"), F.array("p_type").alias("aliases"))
    asked = F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise(F.col("entity_type"))
    return K.link_mentions(part.select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("text"), asked.alias("entity_type")), catalog, True)


def _merged_parts(spark, d):
    """Parts in two types, and merges among them: into the part of half the key, some back from there (cycles), some to a
    third of the key as well (double targets), some to what is not there, in an order that is not that of the keys."""
    part = _t(spark, d, "part").withColumn("entity_type", (F.col("p_size") % 2).cast("string"))
    k = F.col("p_partkey").cast("long")
    one = lambda n, chosen, s, t: part.where(chosen).select((k * 4 + n).alias("x"), s.alias("source_id"), t.cast("long").alias("target_id"))
    half, third = F.floor(k / 2), F.floor(k / 3)
    merges = one(0, F.lit(True), k, half).unionByName(one(1, k % 5 == 0, half, k)).unionByName(one(2, k % 7 == 0, k, third)).unionByName(one(3, k % 50 == 0, k, -k))
    return part.select(k.alias("entity_id"), "entity_type", F.lit("active").alias("status"), "p_brand"), merges.select((F.col("x") * 7919 % 2147483647).alias("seq"), "source_id", "target_id")


def merge_entities(spark, d):
    """All merges of parts, with aliases and mentions counted where they ended up."""
    entities, merges = _merged_parts(spark, d)
    mentions = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("mention_id"))
    done, aliases, moved, _ = I.merge_entities(entities.drop("p_brand"), entities.select("entity_id", F.col("p_brand").alias("value")), mentions, merges)
    n = moved.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    a = aliases.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_aliases"))
    return done.select("entity_id", "status").join(n, "entity_id", "left").join(a, "entity_id", "left")


def identity_operations(spark, d):
    """What each merge of parts did, and which part lived on for its target then."""
    return I.replay_merges(*_merged_parts(spark, d))[1]


def identity_as_of(spark, d):
    """Which part each lived on as after the operations in the first half of the order."""
    return I.replay_merges(*_merged_parts(spark, d), as_of=1 << 30)[0]


def identity_history(spark, d):
    return I.merge_history(*_merged_parts(spark, d))


def apply_alias_ops(spark, d):
    events = _t(spark, d, "events")
    start = events.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("value")).distinct().withColumn("active", F.lit(True))
    ops = events.where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("value"), F.when(F.col("value") > 50, "add").otherwise("remove").alias("action"), F.col("event_id").alias("seq"))
    return K.apply_alias_ops(start, ops)


def align_spans(spark, d):
    """The third word of each document, with an offset that is off."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    spans = docs.select(F.col("chunk_id").alias("span_id"), "chunk_id", F.lit(7).alias("start_offset"), F.get(F.split("content", " "), F.lit(2)).alias("quote")).where("length(quote) > 1")
    return K.align_spans(spans, docs).select("span_id", "start_offset")


def _evidence(spark, d):
    docs = _t(spark, d, "documents")
    start = (F.col("n_chars") % 40).cast("int")
    quote = F.when(F.col("doc_id") % 7 == 0, F.lit("no such text")).otherwise(F.substring("text", start + 1, F.lit(12)))
    return docs.select(
        F.col("source").alias("package_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.col("lang").alias("step_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("version_id"),
        F.when(F.col("doc_id") % 11 == 0, "old").otherwise("g1").alias("generation_id"), start.alias("start_offset"), quote.alias("source_text"),
        ((F.col("doc_id") % 10) / 10).alias("relevance"), ((F.col("n_chars") % 10) / 10).alias("quality"),
    ), docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("version_id"), F.col("text").alias("content"))


def validate_spans(spark, d):
    evidence, sources = _evidence(spark, d)
    valid, issues = E.validate_evidence(evidence, sources, "g1")
    return valid.select("package_id", "evidence_id", F.lit("valid").alias("state")).unionByName(issues.select("package_id", "evidence_id", F.col("issue").alias("state")))


def rank_citations(spark, d):
    evidence, sources = _evidence(spark, d)
    valid, _ = E.validate_evidence(evidence, sources, "g1")
    return E.rank_citations(valid).select("package_id", "evidence_id", F.round("citation_score", 4).alias("score"), "citation")


def reconcile_items(spark, d):
    """Five items of a source, each with all languages as values: what is kept, and what differs from an item's first value."""
    evidence, sources = _evidence(spark, d)
    valid, _ = E.validate_evidence(evidence, sources, "g1")
    items = _t(spark, d, "documents").select(F.col("source").alias("package_id"), F.concat(F.lit("i"), (F.col("doc_id") % 5).cast("string")).alias("item_id"), F.col("lang").alias("value"), F.array(F.col("doc_id").cast("string")).alias("evidence_ids"), "doc_id")
    merged, clash = E.reconcile_items(items, valid, "doc_id")
    kept = merged.select("package_id", "item_id", "value", F.size("evidence_ids").cast("long").alias("n"), F.lit(None).cast("string").alias("first"))
    return kept.unionByName(clash.select("package_id", "item_id", F.col("right_value").alias("value"), F.lit(0).cast("long").alias("n"), F.col("left_value").alias("first")))


def _packages(spark, d):
    """Users' days as packages, kinds of events as steps: (contract, steps, results, failures, items, sources)."""
    events = _t(spark, d, "events").withColumn("package_id", F.concat_ws("-", "user_id", F.dayofmonth("ts")))
    n, most, kind = F.count(F.lit(1)), F.max("value"), F.col("event_type")
    grouped = events.groupBy("package_id", "user_id", "event_type").agg(n.alias("n"), most.alias("most"), F.count_if(F.col("value") > 10).alias("large"))
    state = F.when(kind == "error", F.when(F.col("most") > 20, "failed").otherwise("partial")).when((kind == "login") & (F.col("n") > 2), "ambiguous").otherwise("success")
    results = grouped.select(
        "package_id", kind.alias("step_id"), state.alias("state"), F.when((kind == "click") & (F.col("n") % 3 == 0), "old").otherwise("g1").alias("generation_id"), F.when(F.col("most") < 60, "complete").otherwise("partial").alias("completeness"),
        F.when(kind != "view", F.col("n")).alias("candidate_count"), F.col("large").alias("processed_count"), F.array(kind).alias("ready_projections"),
        F.when(kind == "error", F.array(F.lit("logs"))).alias("missing_projections"), (F.col("n") / 8).alias("confidence"),
    )
    packages = events.select("package_id", "user_id").distinct()
    contract = packages.select(
        "package_id", F.lit("g1").alias("generation_id"), F.when(F.col("user_id") % 3 == 0, "sample").otherwise("exhaustive").alias("coverage"), F.array(F.lit("view")).alias("mandatory_projections"),
        (F.col("user_id") % 3).alias("minimum_sources"), (F.col("user_id") % 2 == 0).alias("partial_results_allowed"),
    )
    steps = packages.select("package_id", F.explode(F.array(*[F.struct(F.lit(x).alias("step_id"), F.lit(x in ("click", "view")).alias("required"), F.lit(x == "click").alias("generation_required")) for x in ("click", "view", "login", "purchase", "error")])).alias("s")).select("package_id", "s.*")
    clicks = events.where("event_type = 'click'").select("package_id", F.floor(F.col("value") / 10).alias("version_id"), F.lit(1).alias("chunk_id"))
    return contract, steps, results, events.where("event_type = 'error' AND value > 40").select("package_id"), events.where("event_type IN ('click', 'purchase')").select("package_id"), clicks


def completeness(spark, d):
    contract, steps, results, failures, _, sources = _packages(spark, d)
    found = E.completeness(contract, steps, results, failures, E.source_issues(contract, sources))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("ready_projections", "missing_projections")})


def answer_states(spark, d):
    contract, steps, results, failures, items, sources = _packages(spark, d)
    issues = E.source_issues(contract, sources)
    complete = E.completeness(contract, steps, results, failures, issues)
    return E.answer_state(contract, results, complete, items, sources, failures.limit(0), failures, issues)


def boundary_issues(spark, d):
    docs = _t(spark, d, "documents")
    results = docs.select(F.col("source").alias("package_id"), F.col("lang").alias("step_id"), F.col("lang").alias("workspace_id"))
    steps = docs.where("lang <> 'fr'").select(F.col("source").alias("package_id"), F.col("lang").alias("step_id")).distinct()
    return E.check_boundaries(results, steps, docs.select(F.col("source").alias("package_id"), F.col("doc_id").alias("source_id")))


def _usage(spark, d):
    """Events as usage: the type is the model, the value its tokens; logins have no rate."""
    events = _t(spark, d, "events").select("event_id", F.col("user_id").alias("workspace_id"), F.lit("own").alias("provider"), F.col("event_type").alias("model"), F.round("value").cast("long").alias("input_tokens"), F.round("value").cast("long").alias("total_tokens"), "ts")
    rates = events.select("provider", "model").distinct().where("model <> 'login'").select("provider", "model", (F.length("model") * 0.5).alias("input"), F.lit(0.0).alias("cached"), F.lit(0.0).alias("output"), F.lit(0.0).alias("embedding"))
    return L.price_usage(events, rates)


def price_usage(spark, d):
    return _usage(spark, d).select("event_id", "cost_status", F.round(F.col("cost_amount").cast("double"), 8).alias("cost"))


def usage_totals(spark, d):
    totals = L.usage_totals(_usage(spark, d), [[], ["model"], ["workspace_id", "model"]])
    return totals.select("workspace_id", "model", "view", "events", "tokens", F.round(F.col("cost").cast("double"), 8).alias("cost"))


def daily_budget(spark, d):
    priced = _t(spark, d, "events").withColumn("cost_status", F.when(F.col("event_type") == "view", "estimated").when(F.col("event_type") == "click", "local_zero").otherwise("exact"))
    days = L.daily_budget(priced, "value", "ts", 150.0, ["user_id"], "cost_status")
    return days.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("spend", 4).alias("spend"), "over")


def runs_by_state(spark, d):
    return L.runs_by_state(_t(spark, d, "orders"), ["o_orderpriority"], ["F", "O", "P"], "o_orderstatus")


def run_states(spark, d):
    """Each user's latest event as the state of a run."""
    return L.run_states(_t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))).select("run_id", "state")


def memory_window(spark, d):
    return L.memory_window(_t(spark, d, "conversations"), 3, 40)


def conversation_titles(spark, d):
    return L.conversation_titles(_t(spark, d, "conversations"))


def carry_focus(spark, d):
    """Turns of two types and of unknown type, with the last three entities that were in focus."""
    kind = F.when(F.col("turn") % 4 == 3, "unknown").otherwise(F.col("role"))
    turns = _t(spark, d, "conversations").withColumn("entity_type", kind).withColumn("entity_id", F.when(F.length("text") % 3 > 0, F.concat(F.lit("e"), F.length("text") % 5)))
    return L.carry_focus(turns, keep=3).select("conv_id", "turn", "focus", F.concat_ws(",", "recent").alias("recent"))


def tag_queries(spark, d):
    tagged = L.tag_queries(_t(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", "text")
    return tagged.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def catalog_overview(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("workspace_id"))
    gone = _t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit("2026-01-01").alias("deleted_at")).distinct()
    marked = docs.join(gone, "document_id", "left")
    return L.catalog_overview(marked, docs)


def generation_ready(spark, d):
    """Users as generations and their event types as stages."""
    events = _t(spark, d, "events")
    generations = events.select(F.col("user_id").alias("generation_id"), (F.col("user_id") % 5).alias("workspace_id"), F.lit("in").alias("source_fingerprint"), F.col("user_id").alias("created_at")).distinct()
    stages = events.groupBy(F.col("user_id").alias("generation_id"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("v"))
    stages = stages.withColumns({"state": F.when(F.col("v") > 400, "ready").otherwise("failed"), "input_fingerprint": F.lit("in"), "output_fingerprint": F.lit("out")})
    return K.generation_ready(generations, stages, ("click", "view", "purchase")).select("generation_id", "ready_stages", "ready", "active")


QUERIES = {
    f.__name__: f
    for f in (
        traverse_out, traverse_in, traverse_multi_hop, reached, reached_in_cycles, resolve_endpoints, event_paths, claim_conflicts, contested_claims, conflict_report, ambiguous_names,
        identity_candidates, resolve_mentions, build_entities, link_mentions, merge_entities, identity_operations, identity_as_of, identity_history, apply_alias_ops, align_spans, validate_spans, rank_citations, reconcile_items, answer_states,
        completeness, boundary_issues, price_usage, usage_totals, daily_budget, runs_by_state, run_states, memory_window, conversation_titles, carry_focus, tag_queries,
        catalog_overview, generation_ready,
    )
}

_KNOWN = """known AS (SELECT p_partkey::VARCHAR AS entity_id, lower(p_name) AS name FROM part WHERE p_size > 25 UNION SELECT p_partkey::VARCHAR, lower(p_type) FROM part WHERE p_size > 45),
sup AS (SELECT l_partkey::VARCHAR AS entity_id, count(DISTINCT l_orderkey || '-' || l_linenumber) AS evidences, count(DISTINCT l_suppkey % 4) AS versions FROM lineitem WHERE l_partkey % 3 > 0 AND l_linenumber < 3 GROUP BY 1),
cand AS (SELECT p_partkey AS mention_id, entity_id, coalesce(evidences, 0) AS evidences, coalesce(versions, 0) AS versions FROM part JOIN known ON known.name = lower(p_name) LEFT JOIN sup USING (entity_id))"""
_PAIRS = """pairs AS (SELECT a.p_name AS subject_id, a.p_partkey AS l, b.p_partkey AS r, a.p_type AS lt, b.p_type AS rt FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand)"""
_EV = """ev AS (SELECT source AS package_id, doc_id::VARCHAR AS evidence_id, lang, (n_chars % 40)::INT AS s, (doc_id % 10) / 10.0::DOUBLE AS relevance, (n_chars % 10) / 10.0::DOUBLE AS quality,
  CASE WHEN doc_id % 11 = 0 THEN 'other_generation' WHEN doc_id % 7 = 0 THEN 'inexact_span' ELSE 'valid' END AS state, doc_id FROM documents)"""
#: The packages of _packages with what decides their completeness and state, in the order of the rules.
_PACKAGES = """WITH e AS (SELECT *, user_id || '-' || day(ts) AS package_id FROM events),
  r AS (SELECT package_id, user_id, event_type AS step, count(*) AS n, max(value) AS most, count(*) FILTER (value > 10) AS large FROM e GROUP BY ALL),
  s AS (SELECT *, CASE WHEN step = 'error' AND most > 20 THEN 'failed' WHEN step = 'error' THEN 'partial' WHEN step = 'login' AND n > 2 THEN 'ambiguous' ELSE 'success' END AS state FROM r),
  p AS (SELECT package_id, user_id, bool_and(state = 'success' AND most < 60) AS whole, sum(n) FILTER (step <> 'view')::BIGINT AS candidate_count, sum(large)::BIGINT AS processed_count,
    string_agg(step, ',' ORDER BY step) AS ready_projections, bool_or(step = 'view') AS viewed, bool_or(step = 'click') AS clicked, bool_or(step = 'error') AS logless, bool_or(step = 'click' AND n % 3 = 0) AS mismatch,
    bool_or(state = 'ambiguous') AS ambiguous, bool_or(state IN ('partial', 'failed')) AS degraded, avg(n / 8) FILTER (state IN ('success', 'partial')) AS confidence FROM s GROUP BY ALL),
  x AS (SELECT package_id, count(DISTINCT floor(value / 10)) FILTER (event_type = 'click') AS sources, count(*) FILTER (event_type IN ('click', 'purchase')) AS items, count(*) FILTER (event_type = 'error' AND value > 40) > 0 AS failed FROM e GROUP BY 1),
  i AS (SELECT *, user_id % 3 AS minimum, user_id % 2 = 0 AS allowed, sources < user_id % 3 OR mismatch AS issue, concat_ws(',', CASE WHEN logless THEN 'logs' END, CASE WHEN NOT viewed THEN 'view' END) AS missing_projections FROM p JOIN x USING (package_id)),
  done AS (SELECT *, CASE WHEN user_id % 3 <> 0 AND whole AND NOT failed AND NOT issue AND missing_projections = '' AND viewed AND clicked THEN 'complete' ELSE 'partial' END AS completeness FROM i)"""
_USE = """us AS (SELECT event_id, user_id AS workspace_id, event_type AS model, round(value)::BIGINT AS tokens,
  CASE WHEN event_type <> 'login' THEN round(value)::BIGINT * length(event_type) * 0.5::DOUBLE / 1000000 END AS cost FROM events)"""
_EDGE = """e AS (SELECT 'lives_in:' || c_custkey AS id, 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'lives_in' AS rel FROM customer UNION ALL
  SELECT 'works_in:' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'works_in' FROM supplier UNION ALL SELECT 'part_of:' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"""

def _re2(pattern: str) -> str:
    """A pattern without look-around: what borders a word is matched instead."""
    return pattern.replace(L._B, r"(?:^|[^\p{L}\p{N}_])").replace(L._E, r"(?:$|[^\p{L}\p{N}_])").replace("'", "''")


#: The merges of _merged_parts replayed one by one: `state` has all parts after each step, `done` what each merge did.
_REPLAY = """WITH RECURSIVE raw AS (SELECT p_partkey * 4 AS x, p_partkey AS s, p_partkey // 2 AS t FROM part UNION ALL SELECT p_partkey * 4 + 1, p_partkey // 2, p_partkey FROM part WHERE p_partkey % 5 = 0
          UNION ALL SELECT p_partkey * 4 + 2, p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey * 4 + 3, p_partkey, -p_partkey FROM part WHERE p_partkey % 50 = 0),
        ops AS (SELECT row_number() OVER (ORDER BY x * 7919 % 2147483647) AS step, x * 7919 % 2147483647 AS seq, s, t FROM raw),
        state(step, id, kind, root, ended) AS (SELECT 0::BIGINT, p_partkey::BIGINT, p_size % 2, p_partkey::BIGINT, NULL::BIGINT FROM part UNION ALL
          SELECT step, id, kind, CASE WHEN ok AND root = s THEN troot ELSE root END, CASE WHEN ok AND id = s THEN seq ELSE ended END FROM (
            SELECT o.step, id, kind, root, ended, s, seq, max(root) FILTER (id = t) OVER () AS troot,
              coalesce(max(root) FILTER (id = s) OVER () = s AND max(kind) FILTER (id = s) OVER () = max(kind) FILTER (id = t) OVER () AND max(root) FILTER (id = t) OVER () <> s, false) AS ok
            FROM state JOIN ops o ON o.step = state.step + 1)),
        done AS (SELECT seq, s, t, coalesce(a.ended = seq, false) AS applied,
            CASE WHEN a.ended = seq THEN NULL WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN a.kind <> b.kind THEN 'type' WHEN s = t THEN 'same' WHEN a.root <> s THEN 'superseded' ELSE 'same' END AS reason,
            CASE WHEN a.ended = seq THEN b.root END AS survivor_id FROM ops o LEFT JOIN state a ON a.step = o.step AND a.id = s LEFT JOIN state b ON b.step = o.step AND b.id = t)"""

ORACLE = {
    "tag_queries": f"""WITH c AS (SELECT lower(text) AS t FROM conversations), k AS (SELECT CASE WHEN regexp_matches(t, '{_re2(L.LOOKUP)}') THEN 'lookup_documents' WHEN regexp_matches(t, '{_re2(L.COUNT)}') AND regexp_matches(t, '{_re2(L.PROPERTY_TERMS)}') THEN 'count'
        WHEN regexp_matches(t, '{_re2(L.INVENTORY)}') THEN 'list' WHEN regexp_matches(t, '{_re2(L.YEAR)}') THEN 'timeline' WHEN regexp_matches(t, '{_re2(L.IDENTIFY)}') THEN 'identify' WHEN regexp_matches(t, '{_re2(L.DESCRIBE)}') THEN 'describe' ELSE 'generic_qa' END AS operation FROM c)
        SELECT operation, count(*) AS n FROM k GROUP BY 1""",
    "traverse_out": f"WITH {_EDGE} SELECT a AS start, a || '>' || b AS nodes, id AS edges, 1 AS hops FROM e WHERE rel = 'works_in'",
    "traverse_in": f"WITH {_EDGE} SELECT x.b AS start, x.b || '>' || x.a || '>' || y.a AS nodes, x.id || ',' || y.id AS edges, 2 AS hops FROM e x JOIN e y ON y.b = x.a WHERE x.rel = 'part_of'",
    "traverse_multi_hop": f"""WITH {_EDGE} SELECT a AS start, a || '>' || b AS nodes, id AS edges, 1 AS hops FROM e WHERE rel = 'lives_in'
        UNION ALL SELECT x.a, x.a || '>' || x.b || '>' || y.b, x.id || ',' || y.id, 2 FROM e x JOIN e y ON y.a = x.b WHERE x.rel = 'lives_in'""",
    "reached": """SELECT DISTINCT 's' || a.s_suppkey AS start, 's' || b.s_suppkey AS node, 2 AS hops FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier""",
    "reached_in_cycles": """WITH RECURSIVE e AS (SELECT p_partkey::BIGINT AS a, (p_partkey // 16 * 16 + (p_partkey * 5 + 3) % 16)::BIGINT AS b FROM part UNION SELECT p_partkey, p_partkey // 16 * 16 + p_partkey * 2 % 16 FROM part),
        r(start, node, hops) AS (SELECT p_partkey::BIGINT, p_partkey::BIGINT, 0 FROM part UNION SELECT start, b, hops + 1 FROM r JOIN e ON a = node WHERE hops < 16)
        SELECT start, node, min(hops) AS hops FROM r GROUP BY 1, 2 HAVING node <> start""",
    "resolve_endpoints": "SELECT n_nationkey AS edge, 'r' || n_regionkey AS source_id, CASE WHEN n_nationkey < 20 THEN 'r' || n_regionkey END AS target_id FROM nation",
    "event_paths": """WITH p AS (SELECT o_orderkey AS event_id, o_custkey AS entity_id, 'buyer' AS role FROM orders UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 'seller' FROM lineitem)
        SELECT entity_id, role, event_id, o_orderpriority AS event_type, strftime(o_orderdate, '%Y-%m-%d') AS normalized_start FROM p JOIN orders ON o_orderkey = event_id
        WHERE entity_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995' AND '1996'""",
    "claim_conflicts": f'WITH {_PAIRS} SELECT subject_id, l AS "left", r AS "right" FROM pairs',
    "contested_claims": "SELECT l_partkey AS subject_id, count(*) AS n_claims, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "conflict_report": f"""WITH {_PAIRS} SELECT l AS "left", r AS "right", CASE WHEN lt = rt THEN lt ELSE least(lt, rt) || ',' || greatest(lt, rt) END AS evidence_ids FROM pairs""",
    "ambiguous_names": "SELECT p_name AS reference, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS candidates FROM part GROUP BY 1 HAVING count(*) > 1",
    "identity_candidates": f"WITH {_KNOWN} SELECT * FROM cand",
    "resolve_mentions": f"""WITH {_KNOWN}, j AS (SELECT mention_id, count(*) AS n, count(*) FILTER (evidences >= 2 AND versions >= 2) AS sure, min(entity_id) FILTER (evidences >= 2 AND versions >= 2) AS best FROM cand GROUP BY 1)
        SELECT p_partkey AS mention_id, CASE WHEN n IS NULL THEN 'new' WHEN sure = 1 THEN 'linked' ELSE 'unresolved' END AS decision, CASE WHEN sure = 1 THEN best END AS entity_id FROM part LEFT JOIN j ON mention_id = p_partkey""",
    "build_entities": "SELECT p_brand AS entity_id, arg_min(p_name, p_partkey) AS display_name, count(*) AS n_mentions, count(DISTINCT p_name)::INT AS n_aliases FROM part GROUP BY 1",
    "link_mentions": """WITH k AS (SELECT lower(p_name) AS name, p_size > 25 AS large, p_partkey AS id FROM part UNION SELECT lower(p_type), p_size > 25, p_partkey FROM part),
        c AS (SELECT p.p_partkey AS mention_id, count(DISTINCT id) AS n, min(id) AS id FROM part p LEFT JOIN k ON name = lower(p_name) AND (p_partkey % 3 = 0 OR large = (p_size > 25)) GROUP BY 1)
        SELECT mention_id, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN id END AS entity_id FROM c""",
    "merge_entities": f"""{_REPLAY}, m AS (SELECT id, root, ended FROM state WHERE step = (SELECT max(step) FROM state)),
        n AS (SELECT root, count(*) AS n FROM lineitem JOIN m ON id = l_partkey GROUP BY 1), a AS (SELECT root, count(DISTINCT p_brand) AS n FROM m JOIN part ON id = p_partkey GROUP BY 1)
        SELECT id AS entity_id, CASE WHEN ended IS NULL THEN 'active' ELSE 'superseded' END AS status, n.n AS n_mentions, a.n AS n_aliases FROM m LEFT JOIN n ON n.root = id LEFT JOIN a ON a.root = id""",
    "identity_operations": f"{_REPLAY} SELECT seq, s AS source_id, t AS target_id, applied, reason, survivor_id FROM done",
    "identity_as_of": f"""{_REPLAY} SELECT id AS entity_id, root AS survivor_id, ended AS superseded_by_seq FROM state WHERE step = (SELECT count(*) FROM ops WHERE seq <= 1073741824)""",
    "identity_history": f"""{_REPLAY}, rows AS (SELECT s AS entity_id, seq, 'source' AS role, survivor_id AS other_id, applied FROM done UNION ALL SELECT t, seq, 'target', s, applied FROM done UNION ALL SELECT survivor_id, seq, 'survivor', s, applied FROM done WHERE applied AND survivor_id <> t)
        SELECT entity_id, seq, role, other_id, applied, CASE WHEN ended <= seq THEN 'superseded' ELSE 'active' END AS status FROM rows JOIN state ON id = entity_id AND state.step = (SELECT max(step) FROM state)""",
    "apply_alias_ops": """SELECT user_id AS entity_id, event_type AS value, CASE WHEN event_type IN ('click', 'purchase') THEN arg_max(value > 50, event_id) ELSE true END AS active FROM events GROUP BY 1, 2""",
    "align_spans": """WITH q AS (SELECT doc_id, text, string_split(text, ' ')[3] AS w FROM documents), r AS (SELECT *, list_filter(range(0, length(text) - length(w) + 1), lambda i: substr(text, (i + 1)::BIGINT, length(w)) = w) AS p FROM q WHERE length(w) > 1),
        s AS (SELECT *, list_min(list_transform(p, lambda i: abs(i - 7))) AS near FROM r), t AS (SELECT *, list_filter(p, lambda i: abs(i - 7) = near) AS best FROM s)
        SELECT doc_id AS span_id, (CASE WHEN len(best) = 1 THEN best[1] ELSE 7 END)::INT AS start_offset FROM t""",
    "validate_spans": f"WITH {_EV} SELECT package_id, evidence_id, state FROM ev",
    "rank_citations": f"""WITH {_EV}, c AS (SELECT package_id, evidence_id, relevance * 0.6::DOUBLE + quality * 0.3::DOUBLE + 1::DOUBLE / 3 * 0.1::DOUBLE AS score FROM ev WHERE state = 'valid')
        SELECT package_id, evidence_id, round(score, 4) AS score, row_number() OVER (PARTITION BY package_id ORDER BY score DESC, evidence_id DESC) AS citation FROM c""",
    "reconcile_items": f"""WITH {_EV}, h AS (SELECT package_id, 'i' || (doc_id % 5) AS item_id, lang AS value, count(*) AS n, min(doc_id) AS spot FROM ev WHERE state = 'valid' GROUP BY ALL)
        SELECT package_id, item_id, value, n, NULL::VARCHAR AS first FROM h UNION ALL SELECT package_id, item_id, value, 0, first FROM (SELECT *, first_value(value) OVER (PARTITION BY package_id, item_id ORDER BY spot) AS first FROM h) WHERE value <> first""",
    "completeness": f"{_PACKAGES} SELECT package_id, completeness AS state, candidate_count, processed_count, ready_projections, missing_projections, mismatch AS generation_mismatch FROM done",
    "answer_states": f"""{_PACKAGES} SELECT package_id, CASE WHEN ambiguous THEN 'ambiguous' WHEN items > 0 AND sources >= minimum AND completeness = 'complete' THEN 'corpus_complete'
        WHEN items > 0 AND sources >= minimum AND NOT (failed OR issue OR degraded) THEN 'grounded' WHEN items > 0 AND sources >= minimum AND allowed THEN 'partial' ELSE 'unsupported' END AS state, sources, round(coalesce(confidence, 0), 6) AS confidence FROM done""",
    "boundary_issues": """SELECT source AS package_id, 'mixed_workspaces' AS issue, NULL::VARCHAR AS subject FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1
        UNION ALL SELECT source, 'duplicate_result', lang FROM documents GROUP BY source, lang HAVING count(*) > 1
        UNION ALL SELECT DISTINCT source, 'undeclared_step', lang FROM documents WHERE lang = 'fr'""",
    "price_usage": f"WITH {_USE} SELECT event_id, CASE WHEN cost IS NULL THEN 'unpriced' ELSE 'priced' END AS cost_status, round(cost, 8) AS cost FROM us",
    "usage_totals": f"""WITH {_USE} SELECT workspace_id, model, CASE GROUPING(workspace_id) * 2 + GROUPING(model) WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS view, count(*) AS events, sum(tokens)::BIGINT AS tokens,
        round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 8) AS cost FROM us GROUP BY GROUPING SETS ((), (model), (workspace_id, model))""",
    "daily_budget": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS spend, sum(value) >= 150 AS over FROM events WHERE event_type <> 'view' GROUP BY 1, 2",
    "runs_by_state": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "run_states": "SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1",
    "memory_window": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS position, role, left(text, 40) AS text FROM r WHERE r <= 3""",
    "conversation_titles": """SELECT conv_id, CASE WHEN length(t) > 72 THEN rtrim(left(t, 71)) || '…' ELSE t END AS title FROM
        (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1)""",
    # a fold of each conversation's turns: the state is a list of (entity, type), the last to be in focus at its end
    "carry_focus": """WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN turn % 4 = 3 THEN 'unknown' ELSE role END AS k, CASE WHEN length(text) % 3 > 0 THEN 'e' || length(text) % 5 END AS e FROM conversations),
        r AS (SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS turn, NULL::VARCHAR AS focus, []::STRUCT(e VARCHAR, k VARCHAR)[] AS state FROM c WHERE i = 1
          UNION ALL
          SELECT conv_id, i, turn, f.e, CASE WHEN f.e IS NULL THEN state ELSE list_append(list_filter(state, lambda x: x.e <> f.e), f)[-3:] END
          FROM (SELECT r.conv_id, c.i, c.turn, state, CASE WHEN c.e IS NOT NULL THEN {'e': c.e, 'k': c.k} ELSE list_filter(state, lambda x: c.k = 'unknown' OR x.k = c.k)[-1] END AS f FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1))
        SELECT conv_id, turn, focus, array_to_string(list_transform(state, lambda x: x.e), ',') AS recent FROM r WHERE i > 0""",
    "catalog_overview": """SELECT workspace_id, count(*) AS documents, count(*) AS chunks FROM (SELECT source AS workspace_id, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) GROUP BY 1""",
    "generation_ready": """WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2),
        r AS (SELECT user_id, count(*) FILTER (v > 400) AS ready_stages FROM s GROUP BY 1), g AS (SELECT DISTINCT e.user_id, coalesce(ready_stages, 0) AS ready_stages FROM events e LEFT JOIN r USING (user_id))
        SELECT user_id AS generation_id, ready_stages, ready_stages = 3 AS ready, coalesce(user_id = max(user_id) FILTER (ready_stages = 3) OVER (PARTITION BY user_id % 5), false) AS active FROM g""",
}
