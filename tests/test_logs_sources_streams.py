"""Logs, sources and streams on small cases."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators import logs as L
from marginalia.sources import tables as S
from marginalia.sources.store import Store
from marginalia.streaming import jobs as J

OWNER = "Deniz Kaya"


@pytest.mark.parametrize(
    "query,operation,mention,start",
    [
        (f"{OWNER} kim?", "identify", OWNER, None), (f"{OWNER} hakkında neler biliyoruz?", "describe", OWNER, None), (f"1988'de {OWNER} ile ilgili ne olmuş?", "timeline", OWNER, "1988"),
        (f"{OWNER}'in kaç adet tapusu var?", "count", OWNER, None), (f"{OWNER}'nin hangi malları var?", "list", OWNER, None), (f"{OWNER} hangi belgelerde geçiyor?", "lookup_documents", OWNER, None),
        (f"{OWNER} appears in which documents?", "lookup_documents", None, None), ("how is it", "generic_qa", "how is it", None), ("who is it 1990-1995", "timeline", None, "1990"),
    ],
)
def test_tags(spark, query, operation, mention, start):
    row = L.tag_queries(spark.createDataFrame([(1, query)], "id int, text string"), "id", "text").first()
    assert (row.operation, row.date_start) == (operation, start) and row.exhaustive == (operation in ("count", "list"))
    if mention:
        assert row.mention == mention


def test_tags_of_nothing(spark):
    rows = L.tag_queries(spark.createDataFrame([(1, None), (2, " ?")], "id int, text string"), "id", "text").collect()
    assert {(r.operation, r.mention) for r in rows} == {("generic_qa", None)}


def test_expansion(spark):
    df = spark.createDataFrame([(1, "q", "r", "q"), (2, "q", None, None)], "query_id int, query string, resolved string, mention string")
    assert [tuple(r) for r in L.expand_queries(df).orderBy("query_id", "turn").collect()] == [(1, 0, "q"), (1, 1, "r"), (2, 0, "q")]


def test_usage(spark):
    events = spark.createDataFrame([("w", "s1", "p", "m", 1_000_000, 500_000, 100), ("w", "s1", "p", "m", 10, None, None), ("w", "s2", "p", "x", 10, None, None)], "workspace_id string, stage string, provider string, model string, input_tokens long, cached_input_tokens long, output_tokens long").withColumn("total_tokens", F.col("input_tokens"))
    rates = spark.createDataFrame([("p", "m", 2.0, 1.0, 10.0, None)], "provider string, model string, input double, cached double, output double, embedding double")
    priced = L.price_usage(events, rates)
    assert sorted(float(r.cost_amount) for r in priced.collect() if r.cost_amount is not None) == [0.00002, 1.501]
    totals = {(r.stage, r.view): (r.events, r.tokens, r.cost and float(r.cost)) for r in L.usage_totals(priced, [[], ["stage"]]).collect()}
    assert totals == {(None, 0): (3, 1_000_020, None), ("s1", 1): (2, 1_000_010, 1.50102), ("s2", 1): (1, 10, None)}


def test_stage_cost_and_overview(spark):
    df = spark.createDataFrame([("A", "s", 0.1), ("A", "s", 0.2), ("B", "s", None)], "workspace_id string, stage string, estimated_cost_usd double")
    assert {(r.workspace_id, round(r.cost, 6)) for r in L.stage_cost(df).collect()} == {("A", 0.3), ("B", 0.0)}
    docs = spark.createDataFrame([("A", "d1", None), ("A", "d2", "x"), ("B", "d3", None)], "workspace_id string, document_id string, deleted_at string")
    chunks = spark.createDataFrame([("A", "d1"), ("A", "d1"), ("A", "d2")], "workspace_id string, document_id string")
    assert {tuple(r) for r in L.catalog_overview(docs, chunks).collect()} == {("A", 1, 2), ("B", 1, 0)}
    logical = spark.createDataFrame([("s", 1, "l2"), ("s", 0, "l1")], "source_id string, ordinal int, logical_id string")
    report = L.ingestion_report(logical, spark.createDataFrame([("l1",), ("l1",)], "logical_id string")).first()
    assert (report.n_sections, report.n_chunks, [x.logical_id for x in report.sections]) == (2, 2, ["l1", "l2"])


def test_conversations(spark):
    df = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", f"m{i} " + "x" * 100) for i in range(5)], "conv_id string, turn int, role string, text string")
    assert [(r.position, r.text[:2]) for r in L.memory_window(df, 2, 10).orderBy("position").collect()] == [(1, "m3"), (2, "m4")]
    title = L.conversation_titles(df).first().title
    assert len(title) == 72 and title.endswith("…")
    turns = spark.createDataFrame([("c", 1, "person", "e1", "1990"), ("c", 2, "person", None, None), ("c", 3, "place", None, "1991"), ("c", 4, "place", "e2", "1990"), ("c", 5, "person", "e1", None), ("c", 6, "unknown", None, "1992"), ("c", 7, "place", None, None), ("c", 8, "person", "e3", None), ("c", 9, "person", "e4", None), ("c", 10, "place", None, None), ("d", 1, "unknown", None, None)], "conv_id string, turn int, entity_type string, entity_id string, period string")
    got = {(r.conv_id, r.turn): (r.focus, r.recent, r.periods) for r in L.carry_focus(turns, keep=2, period="period", periods=2).collect()}
    assert [got["c", i][0] for i in range(1, 11)] == ["e1", "e1", None, "e2", "e1", "e1", "e2", "e3", "e4", None]
    assert [got["c", i][1] for i in (3, 4, 5, 7, 9)] == [["e1"], ["e1", "e2"], ["e2", "e1"], ["e1", "e2"], ["e3", "e4"]]
    assert got["c", 4][2] == ["1991", "1990"] and got["c", 10][2] == ["1990", "1992"] and got["d", 1] == (None, [], [])


def test_scan_populations(spark):
    """Every resource, a null one and repeated records too, without a cut."""
    rows = [(i, "ab"[i % 2]) for i in range(50)] + [(1, "b"), (99, None)]
    found, state = S.scan_populations(spark.createDataFrame(rows, "record_id long, resource string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, rows))
    assert {tuple(r) for r in state.collect()} == {("a", "exhaustive", 25, 25, True), ("b", "exhaustive", 26, 26, True), (None, "exhaustive", 1, 1, True)}


def test_active_corpus(spark):
    docs = spark.createDataFrame([("w", "d1", "v2", None), ("w", "d2", "v3", "x"), ("u", "d3", "v4", None)], "workspace_id string, document_id string, active_version_id string, deleted_at string").withColumn("title", F.lit("t"))
    chunks = spark.createDataFrame([("w", "d1", "v1", "old"), ("w", "d1", "v2", "new"), ("w", "d2", "v3", "gone"), ("u", "d3", "v4", "other")], "workspace_id string, document_id string, version_id string, chunk_id string")
    assert [r.chunk_id for r in S.active_corpus(chunks, docs, "w").collect()] == ["new"]
    logical = spark.createDataFrame([("d1", "v2", "l", "s", "c")], "document_id string, version_id string, logical_id string, title string, content string")
    versions = spark.createDataFrame([("v2", "whole"), ("v4", "all")], "version_id string, content string")
    assert {(r.logical_id, r.content) for r in S.active_logical_documents(logical, versions, docs).collect()} == {("l", "c"), ("v4", "all")}
    population = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b")], "record_id string, resource string")
    rows, state = S.scan_population(population, "a", "discovery", 1)
    assert [r.record_id for r in rows.collect()] == ["r1"] and tuple(state.first())[2:] == (2, 1, False)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes(b" \n ")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    docs, rejects = S.read_text_documents(spark, str(tmp_path))
    assert [r.text for r in docs.collect()] == ["one\ntwo\nthree"] and rejects.count() == 1
    found = {r.path[-5:]: (r.accepted, r.reason) for r in S.classify_files(S.read_files(spark, str(tmp_path))).collect()}
    assert found == {"/a.md": (True, None), "b.txt": (True, None), "c.pdf": (True, None), "d.pdf": (False, "content"), "e.exe": (False, "extension")}


def test_artifacts(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps([{"id": "a", "text": "Ankara Türkiye başkenti", "attributes": {"title": "Ankara"}}, {"id": "b", "text": "x"}]))
    got = {r.id: r.attributes for r in S.read_json_artifacts(spark, str(tmp_path / "j.json"), "entities").collect()}
    assert got == {"a": {"title": "Ankara"}, "b": {}}
    spark.createDataFrame([("a", "T", "D", [1])], "id string, title string, description string, n array<int>").write.parquet(str(tmp_path / "p"))
    row = S.read_graph_artifacts(spark, str(tmp_path / "p"), "entities").first()
    assert (row.id, row.text, row.attributes) == ("a", "D", {"title": "T", "n": "[1]"})
    relations = spark.createDataFrame([("r", {"source": "Ankara", "target": "z"}, "t")], "id string, attributes map<string,string>, text string")
    nodes, edges = S.graph_tables(S.read_json_artifacts(spark, str(tmp_path / "j.json"), "entities"), relations)
    assert {r.node for r in nodes.collect()} == {"Ankara", "b", "z"} and edges.first().target == "z"


def test_extractions(spark):
    good = json.dumps({"mentions": [{"mention_id": "m", "text": "x", "entity_type": "p", "start_offset": 1}], "claims": []})
    df = spark.createDataFrame([("c1", good), ("c2", "{broken"), ("c3", "[]"), ("c4", None)], "chunk_id string, bundle string")
    parts, rejects = S.parse_extractions(df)
    assert [(r.chunk_id, r.mention_id, r.start_offset) for r in parts["mentions"].collect()] == [("c1", "m", 1)]
    assert parts["relations"].count() == 0 and {(r.chunk_id, r.reason) for r in rejects.collect()} == {("c2", "json"), ("c3", "object"), ("c4", "json")}
    bundles = [("a", {"mentions": None, "claims": [{"claim_id": "k", "more": 1}]}), ("b", {"mentions": "text"}), ("c", {"events": [{"event_id": "e", "participants": [{"mention_id": "m", "role": None}]}], "other": [1]}), ("d", {"mentions": [{"start_offset": "no number"}], "claims": [{"claim_id": "l"}]}), ("e", {})]
    parts, rejects = S.parse_extractions(spark.createDataFrame([(i, json.dumps(b)) for i, b in bundles], "chunk_id string, bundle string"))
    assert sorted(tuple(r)[:2] for r in parts["claims"].collect()) == [("a", "k"), ("d", "l")] and [tuple(r) for r in parts["mentions"].collect()] == [("d", None, None, None, None)]
    event = parts["events"].first()
    assert (event.chunk_id, event.participants[0].mention_id, event.temporal_ids) == ("c", "m", None)
    assert {(r.chunk_id, r.reason) for r in rejects.collect()} == {("b", "mentions")}


def test_index_scope(spark, tmp_path):
    rows = spark.createDataFrame([("a", "g", "t", 1)], "workspace_id string, generation_id string, term string, tf int")
    S.write_index(rows, rows, str(tmp_path / "i"), ["workspace_id", "generation_id"])
    other = rows.withColumn("workspace_id", F.lit("b"))
    S.write_index(other, other, str(tmp_path / "i"), ["workspace_id", "generation_id"])
    assert S.read_index(spark, str(tmp_path / "i"), {"workspace_id": "a", "generation_id": "g"})[0].count() == 1
    with pytest.raises(ValueError):
        S.read_index(spark, str(tmp_path / "i"), {"workspace_id": "c", "generation_id": "g"})


def test_vectors(spark):
    df = spark.createDataFrame([("w", "c1", "h", [1.0, 2.0], 1), ("w", "c1", "h", [3.0, 4.0], 2)], "workspace_id string, chunk_id string, config_hash string, embedding array<double>, version int")
    first = S.upsert_vectors(None, df, 2, "h", ["workspace_id"], ["chunk_id"])
    assert [r.embedding for r in first.collect()] == [[3.0, 4.0]]
    again = S.upsert_vectors(first, df.withColumn("chunk_id", F.lit("c2")), 2, "h", ["workspace_id"], ["chunk_id"])
    assert again.count() == 2 and S.upsert_vectors(first, df, 2, "h", ["workspace_id"], ["chunk_id"]).count() == 1
    for dimension, config in ((3, "h"), (2, "other")):
        with pytest.raises(PySparkException):
            S.upsert_vectors(None, df, dimension, config, ["workspace_id"], ["chunk_id"]).collect()


def test_corpus_text(spark, tmp_path):
    S.write_corpus_text(spark.createDataFrame([("d", "T", "body")], "document_id string, title string, content string").coalesce(1), str(tmp_path / "t"), ["document_id", "title"])
    assert spark.read.text(str(tmp_path / "t"), wholetext=True).first().value.strip() == "document_id: d\ntitle: T\n\nbody"


def _stream(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode("append").parquet(str(tmp_path / "in"))
    return J.read_events(spark, str(tmp_path / "in"), df.schema)


PENDING = "w string, n long, cost double, made boolean"


def test_pending_updates(spark, tmp_path):
    """Size before cost before threshold; a made update begins anew; the count is kept between runs, and can be read."""

    def run(rows):
        stream = J.pending_updates(_stream(spark, tmp_path, rows, PENDING), "w", "n", "cost", "made", threshold=2, most=3, warning=1.0)
        found = J.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
        return {(r.workspace, r.at): (r.action, r.reason, r.pending, r.cost_warning) for r in found}

    found = run([("a", 1, 0.1, False), ("a", 2, None, False), ("b", 1, 1.0, False), ("a", 3, 5.0, False), ("a", 4, 5.0, False)])
    assert found == {
        ("a", 1): ("none", "manual_update_required", 1, False), ("a", 2): ("queue", "threshold_reached", 2, False), ("b", 1): ("confirmation_required", "cost_warning", 1, True),
        ("a", 3): ("confirmation_required", "cost_warning", 3, True), ("a", 4): ("confirmation_required", "maximum_documents_exceeded", 4, True),
    }
    found = run([("a", 5, 0.0, False), ("a", 6, None, True), ("a", 7, 0.0, False), ("b", 2, 0.0, False)])
    assert found["a", 5][1:3] == ("maximum_documents_exceeded", 5) and found["a", 6][:3] == ("reset", "completed", 0) and found["a", 7][2] == 1 and found["b", 2][:3] == ("queue", "threshold_reached", 2)
    assert {tuple(r) for r in J.state_of(spark, str(tmp_path / "ck"), "pending").collect()} == {("a", 1), ("b", 2)}


def test_manual_updates_are_not_queued(spark, tmp_path):
    stream = J.pending_updates(_stream(spark, tmp_path, [("a", i, 0.0, False) for i in range(3)], PENDING), "w", "n", "cost", threshold=2, automatic=False)
    assert {r.action for r in J.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()} == {"none"}


def test_spend_is_kept_current(spark, tmp_path):
    """Late usage changes its day; what is later than the watermark does not; state is of days that are not over."""
    day = lambda d, h: datetime.datetime(2026, 1, d, h)
    store, schema = Store(spark, str(tmp_path / "store")), "w string, amount double, ts timestamp, status string"

    def run(rows):
        days = J.daily_budget_stream(_stream(spark, tmp_path, rows, schema), ["w"], "amount", "ts", 3.0, "1 day", "status")
        return {(r.w, r.day.day): (r.spend, r.over) for r in J.keep_current(days, store, "days", ["w", "day"], str(tmp_path / "ck")).collect()}

    assert run([("a", 1.0, day(1, 5), "exact"), ("a", 9.0, day(1, 6), "estimated"), ("b", 3.0, day(1, 5), "local_zero")]) == {("a", 1): (1.0, False), ("b", 1): (3.0, True)}
    assert run([("a", 2.0, day(1, 9), "exact"), ("a", 1.0, day(2, 9), "exact")]) == {("a", 1): (3.0, True), ("b", 1): (3.0, True), ("a", 2): (1.0, False)}
    run([("a", 1.0, day(9, 1), "exact")])
    assert run([("a", 5.0, day(1, 9), "exact"), ("a", 1.0, day(9, 2), "exact")])["a", 1] == (3.0, True)
    state = spark.read.format("statestore").load(str(tmp_path / "ck"))
    assert state.count() == 1
    versions = store.versions()
    assert run([]) and store.versions() == versions


def test_stale_runs_are_interrupted(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)

    def run(rows):
        states = J.run_states(_stream(spark, tmp_path, rows, "run_id string, state string, at timestamp"), "10 minutes", "1 minute")
        return sorted((r.run_id, r.state) for r in J.run_to_end(states, str(tmp_path / "out"), str(tmp_path / "ck")).collect())

    run([("a", "running", at(0)), ("b", "cancelling", at(0)), ("c", "completed", at(0)), ("d", "running", at(0))])
    run([("d", "running", at(9)), ("x", "queued", at(12))])
    found = run([("x", "queued", at(13))])
    assert ("a", "interrupted") in found and ("b", "interrupted") in found and ("c", "interrupted") not in found and ("d", "interrupted") not in found


def test_usage_once_and_states(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("k1", at), ("k1", at), ("k2", at)]
    once = J.run_to_end(J.dedupe_usage(_stream(spark, tmp_path / "u", rows, "key string, ts timestamp"), "key", "ts"), str(tmp_path / "u_out"), str(tmp_path / "u_ck"))
    assert once.count() == 2
    steps = [("r", "queued", at), ("r", "running", at + datetime.timedelta(minutes=1)), ("s", "running", at), ("s", "completed", at + datetime.timedelta(minutes=2))]
    states = J.run_to_end(J.run_states(_stream(spark, tmp_path / "s", steps, "run_id string, state string, at timestamp")), str(tmp_path / "s_out"), str(tmp_path / "s_ck"))
    assert {(r.run_id, r.state) for r in states.collect()} >= {("r", "queued"), ("r", "running"), ("s", "running"), ("s", "completed")}
    batch = L.run_states(spark.createDataFrame(steps, "run_id string, state string, at timestamp"), F.lit(at + datetime.timedelta(hours=1)))
    assert {(r.run_id, r.state) for r in batch.collect()} == {("r", "interrupted"), ("s", "completed")}
