"""Corpus preparation and retrieval on small cases."""

import datetime
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import corpus as C
from marginalia.operators import retrieval as Q


def test_sections(spark):
    text = "# Archive\nintro\n## S.17\nfirst\n### deeper\nmore\n## Future Archive Ω 2026\nlast"
    docs = spark.createDataFrame([(1, text), (2, "no heading\n# one")], "doc_id long, text string")
    named = docs.withColumn("source_original", F.lit("in/a.tar.gz"))
    assert {r.title for r in C.split_logical(named).where("doc_id = 2").collect()} == {"a.tar"} and {r.title for r in C.split_logical(named).where("doc_id = 1").collect()} == {"S.17", "Future Archive Ω 2026"}
    got = sorted(tuple(r) for r in C.split_logical(docs).collect())
    assert got == [(1, 0, "S.17", "## S.17\nfirst\n### deeper\nmore"), (1, 1, "Future Archive Ω 2026", "## Future Archive Ω 2026\nlast"), (2, 0, None, "no heading\n# one")]


def test_section_pages(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 3)], "doc_id long, ordinal int, page_start int")
    assert [r.page_end for r in C.section_pages(df).orderBy("ordinal").collect()] == [2, 3, 3]
    assert [r.page_end for r in C.section_pages(df.withColumn("total_pages", F.lit(9))).orderBy("ordinal").collect()] == [2, 3, 9]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "# Başlık\n\nBir iki üç.\n\nDört beş altı."), (2, None), (3, " ".join(f"w{i}" for i in range(10)))], "doc_id long, content string")
    rows = C.chunk_corpus(df, 4, 1).orderBy("doc_id", "ordinal").collect()
    assert [(r.ordinal, r.content, r.heading) for r in rows if r.doc_id == 1] == [(0, "Bir iki üç.", "Başlık"), (1, "üç. Dört beş altı.", "Başlık")]
    long = [r.content.split() for r in rows if r.doc_id == 3]
    assert long == [["w0", "w1", "w2", "w3"], ["w3", "w4", "w5", "w6"], ["w6", "w7", "w8", "w9"]]
    assert not [r for r in rows if r.doc_id == 2]
    texts = [(1, "## A\n \n## B\nb c\n \t\nd # e\n\n#\nf"), (2, "## only\n\n"), (3, "a b c\n\nd e f g h i j")]
    rows = C.chunk_corpus(spark.createDataFrame(texts, "doc_id long, content string"), 5, 2).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.content, r.heading) for r in rows] == [(1, "b c d # e", "B"), (1, "# e f", "B"), (3, "a b c", None), (3, "b c d e f", None), (3, "e f g h i j", None)]


def test_chunk_volume(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("# Title\n\n"), F.repeat(F.lit("three word sentence. "), 20)).alias("content"))
    assert C.chunk_corpus(docs).count() == 5000


def test_versions(spark):
    docs = spark.createDataFrame([("d", "v1")], "document_id string, active_version_id string")
    versions = spark.createDataFrame([("v1", "d", 1, "h1")], "version_id string, document_id string, version_number int, source_hash string")
    new = spark.createDataFrame([("d", "v2", "h2")], "document_id string, version_id string, source_hash string")
    every, moved = C.apply_versions(new, docs, versions)
    assert {(r.version_id, r.version_number) for r in every.collect()} == {("v1", 1), ("v2", 2)}
    assert moved.first().active_version_id == "v2"


def test_metadata_precedence(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [("d", "title", "system", "s", at), ("d", "title", "user", "u", at), ("d", "title", "extracted", "e", at), ("d", "lang", "system", "x", at), ("d", "lang", "system", "y", at + datetime.timedelta(1))]
    df = spark.createDataFrame(rows, "document_id string, key string, origin string, value string, updated_at timestamp")
    assert {(r.key, r.value) for r in C.effective_metadata(df, ["document_id"]).collect()} == {("title", "u"), ("lang", "y")}


def test_fingerprints(spark):
    a = spark.createDataFrame([("w", 1, "x"), ("w", 2, None)], "w string, id int, t string")
    same = C.corpus_fingerprint(a.orderBy(F.col("id").desc()).repartition(3), ["w"], ["id", "t"]).first()
    assert same == C.corpus_fingerprint(a, ["w"], ["id", "t"]).first()
    other = C.corpus_fingerprint(a.withColumn("t", F.coalesce("t", F.lit(""))), ["w"], ["id", "t"]).first()
    assert same != other
    one = C.curation_fingerprint(a, a, a.limit(0)).first()
    assert one != C.curation_fingerprint(a, a.limit(0), a).first()


def test_reindex(spark):
    rows = [("a", None, 1, "c", "ready"), ("b", 1, 2, "c", "ready"), ("c", 3, 2, "c", "ready"), ("d", 3, 2, "old", "ready"), ("e", 3, 2, "c", "failed"), ("f", 3, 2, "c", "building"), ("g", 3, 2, "c", None)]
    df = spark.createDataFrame(rows, "workspace_id string, built_at int, corpus_changed_at int, config_hash string, state string")
    got = {r.workspace_id: (r.action, r.reason) for r in C.plan_reindex(df, F.lit("c")).collect()}
    assert got == {"a": ("full", "never_built"), "b": ("full", "corpus_changed"), "c": ("none", "current"), "d": ("full", "config_changed"), "e": ("full", "failed"), "f": ("full", "building"), "g": ("full", "unknown")}


def test_copy_guard(spark):
    source = "one two three four five six seven eight nine ten eleven twelve thirteen"
    answers = spark.createDataFrame([(1, "so: " + source.upper()), (2, "twelve eleven ten nine eight seven six five four three two one zero")], "item_id int, text string")
    found = C.verbatim_overlap(answers, spark.createDataFrame([(9, source)], "doc_id int, text string")).collect()
    assert [(r.answer, r.source, r.shared, r.longest) for r in found] == [(1, 9, 1, 13)]


def test_verbatim_runs(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    sources = [(i, text(rnd.choice([3, 11, 60]))) for i in range(12)] + [(99, "x, y; (z) " * 5)]
    cut = lambda: rnd.choice(sources)[1].split()[rnd.randrange(9) :][:25]
    answers = [(i, ", ".join(cut() + [text(2)] + cut()).upper()) for i in range(12)] + [(50, None), (51, "X y.Z! x y z x y z x y z")]
    want = set()
    for a, left in answers:
        for s, right in sources:
            p, q = (re.findall(r"\w+", (t or "").lower()) for t in (left, right))
            for x in range(len(p)):
                for y in range(len(q)):
                    if not (x and y and p[x - 1] == q[y - 1]):
                        n = next((k for k in range(len(p)) if x + k >= len(p) or y + k >= len(q) or p[x + k] != q[y + k]), len(p))
                        if n >= 12:
                            want.add((a, s, x, y, n))
    found = C.verbatim_runs(spark.createDataFrame(answers, "item_id int, text string"), spark.createDataFrame(sources, "doc_id int, text string")).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 10


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id int, text string").coalesce(1)

    def one_by_one(texts):
        if len(texts) > 1:
            raise RuntimeError("too many")
        return [[float(len(t))] for t in texts]

    assert {r.id: r.embedding for r in C.embed_corpus(df, one_by_one, "id", "text", 1, 4).collect()} == {1: [1.0], 2: [2.0], 3: [3.0]}
    with pytest.raises(PySparkException):
        C.embed_corpus(df, lambda t: [[1.0] * (i + 1) for i in range(len(t))], "id", "text", 1).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁ  X ", "1988-1990 and 2001", '["a","b"]', "a/../b", 6, 8)], "m string, y string, ids string, p string, n int, d int")
    r = df.select(
        T.normalized_mention(F.col("m")).alias("m"), T.year_range(F.col("y")).alias("y"), T.id_list(F.col("ids")).alias("ids"), T.folder_parts(F.col("p")).alias("p"), T.reduced_share(F.col("n"), F.col("d")).alias("s"),
        T.reduced_share(F.col("n"), F.lit(0)).alias("z"), T.id_list(F.lit("x, y")).alias("loose"), T.redact_secrets(F.lit("API_KEY=abc x token: q")).alias("log"),
        T.match_reason(F.lit(None).cast("string"), F.lit("One. Ankara is here! Two."), F.lit("ankara")).alias("why"), T.match_reason(F.lit(""), F.concat(F.repeat(F.lit("x"), 155), F.lit("  yyyy zzzz. b")), F.lit("no")).alias("cut"), T.embedding_text(F.lit("t"), F.lit(" "), F.lit("c")).alias("e"),
    ).first()
    assert (r.m, tuple(r.y), r.ids, r.p, r.s, r.z, r.loose) == ("fi x", ("1988", "1990"), ["a", "b"], None, "3/4", None, ["x", "y"])
    assert r.log == "API_KEY=[redacted] x token: [redacted]" and r.why == "Ankara is here!" and r.cut == "x" * 155 + "…" and r.e == "t\nc"


def test_bm25(spark):
    df = spark.createDataFrame([("ankara", "Ankara Türkiye'nin başkentidir."), ("izmir", "İzmir Ege bölgesindedir.")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "Türkiye başkenti")], "q int, text string")
    found = Q.bm25_search(*Q.bm25_index(df, "chunk_id", "content"), queries, 1, "q", "text").collect()
    assert [r.id for r in found] == ["ankara"]


def test_dense_scope(spark):
    points = spark.createDataFrame([("p1", "a", [1.0, 0.0]), ("p2", "b", [1.0, 0.0]), ("p3", "a", [0.0, 0.0])], "id string, workspace_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, "a", [2.0, 0.0]), (2, "c", [1.0, 0.0])], "q int, workspace_id string, embedding array<double>")
    assert [(r.query_id, r.id, r.score) for r in Q.dense_search(points, queries, 5, "id", "q", scope=["workspace_id"]).collect()] == [(1, "p1", 1.0)]


def _list(spark, ids):
    return spark.createDataFrame([(1, x, 1.0 / (i + 1), i + 1) for i, x in enumerate(ids)], "query_id int, id string, score double, rank int")


def test_fusion(spark):
    got = Q.rrf([_list(spark, ["one", "two"]), _list(spark, ["two"])], 2).orderBy("rank").collect()
    assert [(r.id, r.raw_score) for r in got] == [("two", 1.0), ("one", 1.0)]


def test_neighbours(spark):
    chunks = spark.createDataFrame([("hit", "a", "parent", None, "neighbor", ["foreign", "parent"]), ("parent", "a", None, None, None, []), ("neighbor", "a", None, None, None, []), ("foreign", "b", None, None, None, [])], "chunk_id string, workspace_id string, parent string, previous string, next string, related array<string>")
    hits = spark.createDataFrame([(1, "hit", "a", 1)], "query_id int, chunk_id string, workspace_id string, rank int")
    got = Q.expand_neighbors(hits, chunks, ["parent", "previous", "next", "related"]).orderBy("position").collect()
    assert [r.chunk_id for r in got] == ["hit", "parent", "neighbor"]
    two = spark.createDataFrame([(1, "hit", "a", 1), (1, "neighbor", "a", 2), (1, "parent", "a", 3)], hits.schema)
    assert [r.chunk_id for r in Q.expand_neighbors(two, chunks, ["next"]).orderBy("position").collect()] == ["hit", "neighbor", "parent"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "q", "bb", 1), (1, "q", "a", 2), (1, "q", "ccc", 3)], "query_id int, query string, content string, rank int")
    got = Q.rerank(hits, lambda q, t: [-len(x) for x in t], 2).orderBy("rerank").collect()
    assert [(r.content, r.partial) for r in got] == [("a", False), ("bb", False)]

    def broken(q, t):
        raise RuntimeError

    for scorer in (broken, None):
        assert [(r.content, r.partial) for r in Q.rerank(hits, scorer, 3).orderBy("rerank").collect()] == [("bb", True), ("a", True), ("ccc", True)]


def test_hybrid(spark):
    chunks = spark.createDataFrame([("one", "w", "two"), ("two", "w", None)], "chunk_id string, workspace_id string, next string")
    out, stages = Q.hybrid_search(_list(spark, ["one"]).limit(0), _list(spark, ["one"]), chunks, 1, ["next"])
    assert [r.chunk_id for r in out.orderBy("position").collect()] == ["one", "two"]
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    state = lambda found: {r.query_id: r.state for r in Q.retrieval_state(asked, found).collect()}
    assert state(out) == {1: "grounded", 2: "unsupported"}  # an empty list alone makes nothing partial
    contents = chunks.withColumn("content", F.when(F.col("chunk_id") == "two", "long text").otherwise("short"))
    for scorer, order, kept in ((lambda q, t: [len(x) for x in t], ["two"], "grounded"), (None, ["one"], "partial")):
        out, rankings = Q.hybrid_search(_list(spark, ["one"]).limit(0), _list(spark, ["one"]), contents, 1, ["next"], 1, scorer, 5, asked)
        assert [r.chunk_id for r in out.collect()] == order and state(out)[1] == kept
        assert {s: n for s, n in rankings.groupBy("stage").count().collect()} == {"dense": 1, "fused": 1, "expanded": 2, "reranked": 2, "final": 1}


def test_evidence_selection(spark):
    hits = [
        (1, "identify", "Sun Moon", "Sun Moon", "stub", "d1", "12 34 56 78 90", 10.0),
        (1, "identify", "Sun Moon", "Sun Moon", "good", "d2", "Sun Moon bu tapu kaydında malik olarak yer alır ve taşınmaz onun adına kayıtlıdır, buna ek olarak başka hissedarlar da vardır.", 2.0),
        (1, "identify", "Sun Moon", "Sun Moon", "other", "d3", "Another Person 303 ada 16 parsel 1990", 9.0),
        (1, "identify", "Sun Moon", "Sun Moon", "piece", "d4", "parsel", 8.0),
        (2, "generic_qa", None, None, "a", "one", "alpha words here", 4.0),
        (2, "generic_qa", None, None, "b", "one", "beta words here", 3.0),
        (2, "generic_qa", None, None, "c", "two", "gamma words here", 2.0),
        (2, "generic_qa", None, None, "d", "three", "delta words here", 1.0),
    ]
    df = spark.createDataFrame(hits, "query_id int, operation string, mention string, resolved string, chunk_id string, identity string, content string, score double")
    got = Q.select_evidence(df, default=2).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "good"), (2, "a"), (2, "c")]


def test_grouping_and_lookup(spark):
    hits = spark.createDataFrame([(1, "Ankara", "c1", "d", "H", "about ankara. More", 0.9, "T"), (1, "Ankara", "c2", "d", "H", "else", 0.8, "T")], "query_id int, query string, chunk_id string, document_id string, heading string, content string, score double, title string")
    row = Q.group_by_document(hits).first()
    assert (row.chunks, row.best_chunk, row.score) == (["c1", "c2"], "c1", 1.9)
    turned = hits.withColumn("score", F.when(F.col("chunk_id") == "c1", 0.1).otherwise(0.8))
    assert tuple(Q.group_by_document(turned).select("best_chunk", "score").first()) == ("c1", 1.8)  # the chunk that holds the text, and the greatest score
    found = Q.document_lookup(hits, 5)
    assert found.first().reason == "H" and Q.document_lookup(hits.withColumn("heading", F.lit(None).cast("string")), 5).first().reason == "about ankara."
    text = Q.document_context(found, hits.select("chunk_id", "title", "content")).first().context
    assert text == "Document\ndocument_id: d\ndocument_code: \ntitle: T\npage: \nsource_original: \ndocument_type: \nmatching_chunks:\n- about ankara. More\n- else"


def test_lineage(spark):
    a = spark.createDataFrame([("x", ["u1", "u2"])], "artifact_id string, unit_ids array<string>")
    u = spark.createDataFrame([("u1", ["d1"]), ("u2", ["d1", "d2"])], "unit_id string, document_ids array<string>")
    d = spark.createDataFrame([("d1", "l1"), ("d2", "l2")], "document_id string, logical_id string")
    assert Q.artifact_lineage(a, u, d).first().logical_ids == ["l1", "l2"]


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, "one"), (1, "zero"), (2, "none")], "query_id int, id string")
    assert tuple(Q.eval_retrieval(_list(spark, ["two", "one"]), expected, 5).first()) == (0.25, 0.5, 0.25)
