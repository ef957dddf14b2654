"""Graph, knowledge, evidence and property operators on small cases."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evidence as E
from marginalia.operators import graph as G
from marginalia.operators import identity as I
from marginalia.operators import knowledge as K
from marginalia.operators import property as P


def test_traverse_uses_an_edge_once(spark):
    edges = spark.createDataFrame([(1, "a", "b", "x"), (2, "b", "a", "x"), (3, "b", "c", "y")], "edge_id int, source string, target string, relation string")
    start = spark.createDataFrame([("a",)], "node string")
    paths = {("".join(r.nodes), tuple(r.edges)) for r in G.traverse(edges, start, "outgoing", 0, 3).collect()}
    assert paths == {("a", ()), ("ab", (1,)), ("aba", (1, 2)), ("abc", (1, 3))}
    either = {"".join(r.nodes) for r in G.traverse(edges, start, "either", 2, 2, "x").collect()}
    assert either == {"aba"}
    assert {(r.node, r.hops) for r in G.reach(edges, start, "incoming", 1).collect()} == {("b", 1)}
    ring = spark.createDataFrame([(str(i), i, (i + 1) % 7, "r") for i in range(7)] + [("x", 3, 9, "r"), ("loop", 9, 9, "r"), ("other", 0, 50, "s")], "edge_id string, source int, target int, relation string")
    found = G.reach(ring, spark.createDataFrame([(0,), (9,)], "node int"), relation="r").collect()
    assert {(r.start, r.node, r.hops) for r in found} == {(0, i, i) for i in range(1, 7)} | {(0, 9, 4)}
    assert {(r.node, r.hops) for r in G.reach(ring, spark.createDataFrame([(9,)], "node int"), "either", 2, "r").collect()} == {(3, 1), (2, 2), (4, 2)}
    with pytest.raises(ValueError):
        G.traverse(edges, start, "outgoing", 1, 11)


def test_graph_sample(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("hidden",)], "node string")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a", "hidden")], "edge_id int, source string, target string")
    kept, inside = G.graph_sample(nodes, edges, 2, 5)
    assert [r.node for r in kept.collect()] == ["a", "b"] and [r.edge_id for r in inside.collect()] == [1]


def test_endpoints_by_number(spark):
    entities = spark.createDataFrame([("e0", "Alpha", "0"), ("e1", "Beta", "1")], "entity_id string, title string, number string")
    edges = spark.createDataFrame([("0", "1"), ("alpha", "nobody")], "source string, target string")
    ok, lost = G.resolve_endpoints(edges, entities, ["title", "number"])
    assert [(r.source_id, r.target_id) for r in ok.collect()] == [("e0", "e1")] and lost.first().source_id == "e0"


def test_events_and_evidence(spark):
    events = spark.createDataFrame([("v", "sale"), ("w", "gift")], "event_id string, event_type string")
    people = spark.createDataFrame([("v", "a", "buyer"), ("v", "b", "seller"), ("w", "a", "giver")], "event_id string, entity_id string, role string")
    times = spark.createDataFrame([("v", "1988", None)], "event_id string, normalized_start string, normalized_end string")
    ids = spark.createDataFrame([("a",)], "entity_id string")
    assert {(r.event_id, r.normalized_start) for r in G.event_paths(events, people, times, ids).collect()} == {("v", "1988"), ("w", None)}
    assert [r.event_id for r in G.event_paths(events, people, times, ids, "1988", "1988").collect()] == ["v"]
    claims = spark.createDataFrame([(1, "s", "p", "x"), (2, "s", "p", "y"), (3, "s", "p", "x"), (4, "t", "p", "x")], "claim_id int, subject_id string, predicate string, value string")
    found = G.claim_conflicts(claims)
    assert {(r.left, r.right) for r in found.collect()} == {(1, 2), (2, 3)}
    report = G.conflict_report(found, spark.createDataFrame([(1, "e1"), (2, "e2")], "claim_id int, evidence_id string"))
    assert {tuple(r.evidence_ids) for r in report.collect()} == {("e1", "e2"), ("e2",)}
    entities = spark.createDataFrame([("a", "g1"), ("b", "g0")], "entity_id string, generation_id string")
    assert G.lookup_entities(entities, ids, spark.createDataFrame([("a", "e1")], "entity_id string, evidence_id string"), "g1").first().evidence_ids == ["e1"]


def test_spans(spark):
    chunks = spark.createDataFrame([("c", "aXbXcaa"), ("d", "(x).* \\E (x).*")], "chunk_id string, content string")
    spans = spark.createDataFrame([(1, "c", 0, "X"), (2, "c", 2, "X"), (3, "c", 9, "no"), (4, "c", 9, "aa"), (5, "d", 0, "\\E"), (6, "d", 20, "(x).*"), (7, "c", 4, "")], "span_id int, chunk_id string, start_offset int, quote string")
    assert {r.span_id: r.start_offset for r in K.align_spans(spans, chunks).collect()} == {1: 1, 2: 2, 3: 9, 4: 5, 5: 6, 6: 9, 7: 4}
    mentions = spark.createDataFrame([("m1", "c", 1, "X"), ("m2", "c", 0, "X")], "mention_id string, chunk_id string, start_offset int, quote string")
    deps = spark.createDataFrame([("r1", ["m1"]), ("r2", ["m1", "m2"])], "dependent_id string, mention_ids array<string>")
    kept, stay, counts = K.retain_exact(mentions, deps, chunks)
    assert [r.mention_id for r in kept.collect()] == ["m1"] and [r.dependent_id for r in stay.collect()] == ["r1"]
    assert sorted(r.n for r in counts.collect()) == [1, 1, 2, 2]


def test_identity(spark):
    entities = spark.createDataFrame([("e1", "person", "Ada Bey"), ("e2", "person", "Other")], "entity_id string, entity_type string, display_name string")
    aliases = spark.createDataFrame([("e2", "ADA  bey ", True)], "entity_id string, value string, active boolean")
    mentions = spark.createDataFrame([("m1", "ada bey", "person", "x1", "v1"), ("m2", "Ada Bey", "person", "x2", "v2"), ("m3", "Nobody", "person", "x3", "v1")], "mention_id string, text string, entity_type string, evidence_id string, version_id string")
    none = spark.createDataFrame([], "entity_id string, evidence_id string, version_id string")
    known = spark.createDataFrame([("e1", "y1", "w1"), ("e1", "y2", "w2"), ("e1", "y2", "w2"), ("e2", "y3", "w1")], none.schema)
    both = K.identity_candidates(mentions, entities, aliases, none)
    assert {(r.evidences, r.versions) for r in both.collect()} == {(0, 0)}  # mentions do not support themselves
    assert {(r.decision, r.mention_id) for r in K.resolve_mentions(mentions, both).collect()} == {("unresolved", "m1"), ("unresolved", "m2"), ("new", "m3")}
    one = K.identity_candidates(mentions, entities, aliases, known)
    assert {(r.entity_id, r.evidences, r.versions) for r in one.collect()} == {("e1", 2, 2), ("e2", 1, 1)}
    got = {r.mention_id: (r.decision, r.entity_id) for r in K.resolve_mentions(mentions, one).collect()}
    assert got["m1"] == ("linked", "e1") and got["m3"][0] == "new"
    catalog = K.entity_catalog(entities.withColumn("generation_id", F.lit("g")), aliases, "g")
    linked = lambda kind: {r.mention_id: r.state for r in K.link_mentions(mentions.withColumn("entity_type", F.lit(kind)), catalog).collect()}
    assert linked("person") == linked("unknown") == {"m1": "ambiguous", "m2": "ambiguous", "m3": "unknown"} and set(linked("place").values()) == {"unknown"}


def test_merge_and_split(spark):
    entities = spark.createDataFrame([("a", "p", "active"), ("b", "p", "active"), ("c", "q", "active")], "entity_id string, entity_type string, status string")
    aliases = spark.createDataFrame([("a", "x"), ("b", "x")], "entity_id string, value string")
    mentions = spark.createDataFrame([("a", "m1"), ("b", "m2")], "entity_id string, mention_id string")
    merges = spark.createDataFrame([(1, "b", "a"), (2, "c", "a")], "seq int, source_id string, target_id string")
    done, names, moved, ops = I.merge_entities(entities, aliases, mentions, merges)
    assert {r.entity_id: r.status for r in done.collect()} == {"a": "active", "b": "superseded", "c": "active"}
    assert names.count() == 1 and {r.entity_id for r in moved.collect()} == {"a"}
    assert {(r.source_id, r.applied) for r in ops.collect()} == {("b", True), ("c", False)}
    cut = spark.createDataFrame([("a", "m1", "a1"), ("a", "m2", "a2"), ("b", "m9", "b1")], "entity_id string, mention_id string, new_entity_id string")
    split, again, checks = K.split_entities(entities, moved, cut)
    assert {r.entity_id: r.complete for r in checks.collect()} == {"a": True, "b": False}
    assert {(r.entity_id, r.mention_id) for r in again.collect()} == {("a1", "m1"), ("a2", "m2")}
    assert {r.entity_id: r.status for r in split.collect()} == {"a": "split", "b": "active", "c": "active", "a1": "active", "a2": "active"}


def test_claims_and_aliases(spark):
    claims = spark.createDataFrame([(1, "extracted"), (2, "extracted"), (3, "supported"), (4, "supported")], "claim_id int, stage string")
    decisions = spark.createDataFrame([(1, "supported", 2, None), (2, "verified", 2, "r"), (3, "verified", 0, "r")], "claim_id int, to_stage string, evidence_count int, reviewer string")
    assert {r.claim_id: (r.stage, r.violation) for r in K.advance_claims(claims, decisions).collect()} == {1: ("supported", False), 2: ("extracted", True), 3: ("verified", False), 4: ("supported", False)}
    ops = spark.createDataFrame([("e", "x", "add", 1), ("e", "x", "remove", 2), ("e", "y", "add", 3)], "entity_id string, value string, action string, seq int")
    held = spark.createDataFrame([("e", "x", True)], "entity_id string, value string, active boolean")
    assert {(r.value, r.active) for r in K.apply_alias_ops(held, ops).collect()} == {("x", False), ("y", True)}


def test_name_ranking(spark):
    texts = [("c1", "d1", "dün Deniz Kaya Yılmaz geldi, tapu aldı."), ("c2", "d2", "sonra Deniz Kaya Yılmaz gitti, yine Deniz Kaya Yılmaz döndü."), ("c3", "d3", "Ali Kaya 12 34 56 78 numara"), ("c4", "d3", "Kaya geldi"), ("c5", "d4", "Can Kaya oradaydı")]
    chunks = spark.createDataFrame(texts, "chunk_id string, document_id string, content string")
    mentions = spark.createDataFrame([(1, "kaya"), (2, "Dr. KAYA  deniz"), (3, "kay"), (4, ""), (5, "ali kaya can")], "mention_id int, text string")
    people = spark.createDataFrame([("Can Kaya",)], "name string")
    found = {(r.mention_id, r.rank): (r.name, r.score, r.documents, r.passages, r.resolved) for r in K.rank_names(mentions, chunks, people).collect()}
    assert found == {
        (1, 1): ("Deniz Kaya Yılmaz", 0.93, 2, 3, False), (1, 2): ("Can Kaya", 0.87, 1, 1, False), (1, 3): ("Ali Kaya", 0.61, 1, 1, False), (2, 1): ("Deniz Kaya Yılmaz", 0.93, 2, 3, True),
    }
    assert {r.mention_id: r.resolved for r in K.rank_names(mentions, chunks).where("rank = 1").collect()} == {1: True, 2: True}


def test_generations(spark):
    gens = spark.createDataFrame([("g1", "w", "f", 1), ("g2", "w", "f", 2), ("g3", "w", "f", 3)], "generation_id string, workspace_id string, source_fingerprint string, created_at int")
    stages = [(g, s, "ready", "f", "o") for g in ("g1", "g2") for s in K.STAGES] + [("g3", s, "ready", "f", None if s == "claims" else "o") for s in K.STAGES]
    df = spark.createDataFrame(stages, "generation_id string, stage string, state string, input_fingerprint string, output_fingerprint string")
    got = {r.generation_id: (r.ready, r.active) for r in K.generation_ready(gens, df).collect()}
    assert got == {"g1": (True, False), "g2": (True, True), "g3": (False, False)}
    nodes = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g0")], "node string, generation_id string")
    edges = spark.createDataFrame([(1, "a", "z")], "edge_id int, source string, target string")
    assert {r.issue for r in K.extracted_issues(nodes, edges, "g1").collect()} == {"duplicate_node", "missing_end", "other_generation"}
    report = K.cutover_report(gens, {"late": F.col("created_at") > 1}).orderBy("generation_id").collect()
    assert [(r.accepted, r.reasons) for r in report][0] == (False, ["late"])


def test_evidence(spark):
    sources = spark.createDataFrame([("c", "v", "hello world")], "chunk_id string, version_id string, content string")
    rows = [("p", "e1", "s1", "c", "v", "g", 0, "hello", 0.5, 0.5), ("p", "e2", "s2", "c", "v", "g", 0, "hello", 0.9, 0.1), ("p", "e3", "s1", "c", "v", "g", 1, "hello", 1.0, 1.0), ("p", "e4", "s1", "c", "v", "old", 0, "hello", 1.0, 1.0), ("p", "e5", "s1", "x", "v", "g", 0, "hello", 1.0, 1.0), ("p", "e6", "s1", "c", "v", "g", 6, "world", 0.1, 0.1), ("p", "e6", "s1", "c", "v", "g", 0, "hello", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "package_id string, evidence_id string, step_id string, chunk_id string, version_id string, generation_id string, start_offset int, source_text string, relevance double, quality double")
    valid, issues = E.validate_evidence(df, sources, "g")
    row = valid.first()
    assert valid.count() == 1 and (row.evidence_id, row.aliases, row.relevance, row.quality, row.steps) == ("e1", ["e1", "e2"], 0.9, 0.5, ["s1", "s2"])
    assert {(r.evidence_id, r.issue) for r in issues.collect()} == {("e3", "inexact_span"), ("e4", "other_generation"), ("e5", "unknown_source"), ("e6", "conflicting_id")}
    items = spark.createDataFrame([("p", "i1", "x", ["e1"]), ("p", "i2", "x", ["e2"]), ("p", "i1", "y", ["e2"]), ("p", "i3", "z", ["e4"]), ("p", "i1", "x", ["e2", "e4"])], "package_id string, item_id string, value string, evidence_ids array<string>")
    merged, clash = E.reconcile_items(items, valid)
    assert {(r.item_id, r.value, tuple(r.evidence_ids)) for r in merged.collect()} == {("i1", "x", ("e1",)), ("i2", "x", ("e1",)), ("i1", "y", ("e1",))}
    assert [tuple(r) for r in clash.collect()] == [("p", "i1", "x", "y")]
    ranked = E.rank_citations(valid)
    assert ranked.first().citation_score == pytest.approx(0.6 * 0.9 + 0.3 * 0.5 + 0.1 * 2 / 3, abs=1e-6)
    same = spark.createDataFrame([("p", "a", 1.0, 1.0, ["s", "t", "u", "v"]), ("p", "b", 1.0, 1.0, ["s", "t", "u"])], "package_id string, evidence_id string, relevance double, quality double, steps array<string>")
    assert {r.evidence_id: (r.citation, r.citation_score) for r in E.rank_citations(same).collect()} == {"b": (1, 1.0), "a": (2, 1.0)}
    links = spark.createDataFrame([("p", "a1", ["e2", "e3"]), ("p", "a2", ["e3"])], "package_id string, artifact_id string, evidence_ids array<string>")
    assert [tuple(r) for r in E.valid_links(links, valid).collect()] == [("p", "a1", ["e1"])]


STATES = [
    # what differs from a package that has all: contract, results (step, state, generation, completeness), failures, issues, items, ambiguities -> completeness, state
    ("all", {}, "complete", "corpus_complete"),
    ("sample", {"coverage": "sample"}, "partial", "grounded"),
    ("few sources", {"minimum": 3}, "partial", "unsupported"),
    ("no item", {"items": 0}, "complete", "unsupported"),
    ("failed", {"failures": 1}, "partial", "partial"),
    ("failed, not allowed", {"failures": 1, "allowed": False}, "partial", "unsupported"),
    ("issue", {"issues": 1}, "partial", "partial"),
    ("a partial result", {"b": ("partial", "g", "complete")}, "partial", "partial"),
    ("an ambiguous result", {"b": ("ambiguous", "g", "complete")}, "partial", "ambiguous"),
    ("ambiguity", {"ambiguities": 1}, "complete", "ambiguous"),
    ("not complete", {"b": ("success", "g", "partial")}, "partial", "grounded"),
    ("another generation", {"a": ("success", "old", "complete")}, "partial", "partial"),
    ("another generation that may be", {"b": ("success", "old", "complete")}, "complete", "corpus_complete"),
    ("required step without result", {"a": None}, "partial", "grounded"),
    ("missing projection", {"mandatory": ["a", "z"]}, "partial", "grounded"),
    ("nothing", {"a": None, "b": None, "items": 0}, "unknown", "unsupported"),
]


def test_states(spark):
    packages = {name: given for name, given, _, _ in STATES}
    contract = spark.createDataFrame([(n, "g", g.get("coverage", "exhaustive"), g.get("mandatory", ["a"]), g.get("minimum", 2), g.get("allowed", True)) for n, g in packages.items()], "package_id string, generation_id string, coverage string, mandatory_projections array<string>, minimum_sources int, partial_results_allowed boolean")
    steps = spark.createDataFrame([(n, s, s == "a", s == "a") for n in packages for s in "ab"], "package_id string, step_id string, required boolean, generation_required boolean")
    rows = [(n, s, *r, 2, 1, ["a", s], None, 0.5 if s == "a" else 0.9) for n, g in packages.items() for s in "ab" if (r := g.get(s, ("success", "g", "complete")))]
    results = spark.createDataFrame(rows, "package_id string, step_id string, state string, generation_id string, completeness string, candidate_count int, processed_count int, ready_projections array<string>, missing_projections array<string>, confidence double")
    of = lambda key, default: spark.createDataFrame([(n,) for n, g in packages.items() for _ in range(g.get(key, default))], "package_id string")
    valid = spark.createDataFrame([(n, "v", str(c)) for n in packages for c in (1, 1, 2)], "package_id string, version_id string, chunk_id string")
    issues = of("issues", 0).unionByName(E.source_issues(contract, valid).select("package_id"))
    complete = E.completeness(contract, steps, results, of("failures", 0), issues)
    found = E.answer_state(contract, results, complete, of("items", 2), valid, of("ambiguities", 0), of("failures", 0), issues)
    states = {r.package_id: r for r in found.collect()}
    report = {r.package_id: r for r in complete.collect()}
    assert {n: (report[n].state, states[n].state) for n in packages} == {n: (c, s) for n, _, c, s in STATES}
    assert (states["all"].confidence, states["nothing"].confidence, states["an ambiguous result"].confidence) == (0.7, 0.0, 0.5)
    assert (report["all"].candidate_count, report["nothing"].candidate_count, report["missing projection"].missing_projections) == (4, None, ["z"])


def cited(*chunks):
    return [("d", c) for c in chunks]


def test_citations(spark):
    df = spark.createDataFrame([(1, "x [1] y [3] z [5][1].", cited(*"abcde")), (2, "none", cited("a")), (3, "bad [2]", cited("a")), (4, "[2] [3] [1] [2]", cited("a", "b", "a")), (5, "[1][99999999999]", cited("a")), (6, "[0]", cited("a")), (7, None, cited("a"))], "message_id int, content string, citations array<struct<document_id:string,chunk_id:string>>")
    audited = E.audit_citations(df)
    got = {r.message_id: (r.content, [c.chunk_id for c in r.citations], r.accepted) for r in audited.collect()}
    assert got == {
        1: ("x [1] y [2] z [3][1].", ["a", "c", "e"], True), 2: ("none", [], False), 3: ("bad [2]", [], False), 4: ("[1] [2] [2] [1]", ["b", "a"], True), 5: ("[1][99999999999]", [], False), 6: ("[0]", [], False), 7: (None, [], False),
    }
    told = spark.createDataFrame([(1, 9, 4), (4, None, None), (3, 2, 0)], "message_id int, input_count int, selected_count int")
    assert {r[0]: tuple(r)[1:] for r in E.citation_summary(audited, told).collect()} == {1: (9, 4, 3, 3, 1), 2: (0, 0, 0, 0, 0), 3: (2, 0, 0, 0, 0), 4: (2, 2, 2, 2, 0), 5: (0, 0, 0, 0, 0), 6: (0, 0, 0, 0, 0), 7: (0, 0, 0, 0, 0)}


def test_orphans(spark):
    refs = spark.createDataFrame([("o", ["a", "b"])], "owner string, refs array<string>")
    assert [tuple(r) for r in E.orphan_refs(refs, spark.createDataFrame([("a",)], "id string")).collect()] == [("o", "b")]


OWNER = "Deniz Kaya"


@pytest.mark.parametrize(
    "text,sheet,block,parcel",
    [
        ("40 pafta 303 ada 16 parsel", "40", "303", "16"), ("40 pafta, 303 ada, 16 sayılı parsel", "40", "303", "16"), ("303 ada 16 parsel", None, "303", "16"), ("1 pafta 68 parsel", "1", None, "68"), ("68 nolu parsel", None, None, "68"),
        ("17 ada 25 parsel", None, "17", "25"), ("248 pafta 1 ada", "248", "1", None), ("17 ada", None, "17", None), ("pafta 40 ada 303 parsel 16", "40", "303", "16"), ("taşınmaz ada 5, 7 parsel", None, "5", "7"), ("parsel no 9", None, None, "9"),
    ],
)
def test_cadastral(spark, text, sheet, block, parcel):
    row = P.cadastral(spark.createDataFrame([(f"{OWNER} {text}",)], "content string")).first()
    assert (row.sheet, row.block, row.parcel) == (sheet, block, parcel)


def test_shares(spark):
    texts = ["Karar No: 980/274", "Esas No: 975/511", "21/04/1988", "980/274", "1/8 hissesi ve 3/4 payı"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in P.classify_shares(df, "id").collect():
        got.setdefault(r.id, []).append(r.kind)
    assert got == {0: ["legal_identifier"], 1: ["legal_identifier"], 2: ["date"], 3: ["unknown_fraction"], 4: ["ownership_share", "ownership_share"]}
    one = spark.createDataFrame([("c", f"1/8 hissesi Ali Bey, 1/8 hissesi Can Bey, 9/64 hissesi {OWNER}", OWNER)], "chunk_id string, content string, entity string")
    assert [(r.relation, r.share) for r in P.ownership_spans(one, "chunk_id").collect()] == [("share_owner", "9/64")]
    two = spark.createDataFrame([("c", f"{OWNER} adına kayıtlıdır. {OWNER}'in payı 1/2", OWNER)], "chunk_id string, content string, entity string")
    assert {(r.relation, r.share) for r in P.ownership_spans(two, "chunk_id").collect()} == {("registered_owner", None), ("share_owner", "1/2")}


def test_property_aggregation(spark):
    text = f"{OWNER} adına kayıtlıdır: il: Ankara ilçe: Çankaya mahalle: Merkez pafta 1 ada 2 parsel 68"
    chunks = spark.createDataFrame([("c1", text), ("c2", text + " tapu"), ("c3", "başka bir metin")], "chunk_id string, content string")
    names = spark.createDataFrame([(OWNER,)], "entity string")
    claims = P.property_claims(chunks, names)
    properties = P.aggregate_properties(claims)
    row = properties.first()
    assert properties.count() == 1 and row.n_claims == 2
    assert claims.select("confidence", "identity_complete", "relations").distinct().count() == 1 and claims.first().confidence == 0.98
    counts = P.property_execution(chunks.withColumn("document_id", F.lit("d")), names, claims, properties).first().asDict()
    assert counts == {"active_documents": 1, "active_chunks": 3, "candidate_documents": 1, "candidate_chunks": 2, "extracted_claims": 2, "deduplicated_properties": 1, "processed_documents": 1, "processed_chunks": 2, "normalized_claims": 2, "complete": True}
    assert (row.fields.province, row.fields.district, row.fields.neighborhood, row.fields.parcel) == ("Ankara", "Çankaya", "Merkez", "68")
    assert tuple(P.property_counts(properties).first()) == (OWNER, 1, 1)
    assert properties.select(P.property_display().alias("d")).first().d == "Ankara, Çankaya, Merkez — 1 pafta, 2 ada, 68 parsel"
    told = chunks.where("false").unionByName(spark.createDataFrame([("f1", f"1 pafta 2 ada 68 parsel tapu, {OWNER} adına kayıtlıdır"), ("f2", f"2 ada 68 nolu parsel tapu, {OWNER}'in payı 1/2"), ("f3", f"9 ada 7 parsel, {OWNER} gördü"), ("f4", f"tapu: {OWNER} için 1/4 hisse"), ("f5", f"tapu: {OWNER} için 1/5 hisse")], "chunk_id string, content string"))
    assert sorted(tuple(r)[1:] for r in P.ownership_facts(told, names).collect() if r.block) == [("1", "2", "68", None, "f1")]
    assert [tuple(r)[1:] for r in P.ownership_facts(told, names).collect() if not r.block] == [(None, None, None, "1/5", "f5")]


def test_claims_need_a_field(spark):
    chunks = spark.createDataFrame([("c1", f"tapu {OWNER} 1/8 hisse"), ("c2", f"tapu 3.4.1988, {OWNER} için pay 0/8 hisse 2/0, D: 4"), ("c3", f"{OWNER}lar 7 parsel"), ("c4", f"{OWNER} 7 numara")], "chunk_id string, content string")
    found = {r.chunk_id: r for r in P.property_claims(chunks, spark.createDataFrame([(OWNER.upper(),)], "entity string")).collect()}
    assert set(found) == {"c2", "c3"} and found["c3"].identity_complete and not found["c2"].identity_complete
    assert (found["c2"].record_date, found["c2"].warnings, found["c2"].extraction_basis, found["c2"].confidence) == ("3.4.1988", ["missing_parcel", "partial_property_identity"], ["explicit_independent_section_label"], 0.9)


def test_names_in_texts(spark, monkeypatch):
    from marginalia.operators import names as N

    texts = spark.createDataFrame([(1, "ABab aba"), (2, None), (3, "STRASSE straße x_ab")], "id int, text string")
    table = spark.createDataFrame([("ab",), ("aba",), ("straße",), ("Strasse",), ("",), (None,)], "name string")
    want = {(1, "ab", 0), (1, "ab", 2), (1, "aba", 0), (1, "ab", 5), (1, "aba", 5), (3, "straße", 0), (3, "Strasse", 0), (3, "straße", 8), (3, "Strasse", 8), (3, "ab", 18)}
    assert {tuple(r)[:3] for r in N.find_names(texts, table, "id", "text").collect()} == want
    monkeypatch.setattr(N, "SHARD_CHARACTERS", 5)
    assert {tuple(r)[:3] for r in N.find_names(texts, table, "id", "text").collect()} == want
    whole = {tuple(r)[:3] for r in N.find_names(texts, table, "id", "text", whole_words=True).collect()}
    assert whole == {(1, "aba", 5), (3, "straße", 0), (3, "Strasse", 0), (3, "straße", 8), (3, "Strasse", 8)}
