"""Queries of the ways from a question to an answer: search stages, evidence, contexts, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import corpus as C
from marginalia.operators import evidence as E
from marginalia.operators import graph as G
from marginalia.operators import logs as L
from marginalia.operators import retrieval as Q
from marginalia.plans import corpus as base
from marginalia.plans.corpus import _BM25, _KEYWORD, _t


def _lists(spark, d, k=10):
    """Ranked lists of BM25 and of keywords, for the same questions."""
    asked = _t(spark, d, "benchmark")
    return base._sparse(spark, d, k), Q.keyword_search(_t(spark, d, "documents"), asked, k, "doc_id", "text", "item_id", "text")


def _linked(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("workspace_id"), (F.col("doc_id") - 20).alias("previous"), (F.col("doc_id") + 20).alias("next"))


def _reranked(spark, d):
    """Fused lists, each hit before the documents of the same source before and after it, the first twelve reranked by length, eight kept."""
    contents = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = _linked(spark, d).join(contents, "chunk_id")
    return Q.hybrid_search(*_lists(spark, d), chunks, 10, ["previous", "next"], 8, lambda queries, texts: [len(t) for t in texts], 12, asked)


def hybrid_search(spark, d):
    return _reranked(spark, d)[0]


def stage_rankings(spark, d):
    """The ranking of every stage of the search."""
    return _reranked(spark, d)[1]


def retrieval_states(spark, d):
    """Questions for some of which one kind of search finds nothing, or both do; every seventh fell back."""
    sparse, dense = _lists(spark, d)
    sparse, dense = sparse.where("query_id % 3 <> 0"), dense.where("query_id % 5 <> 0")
    found, _ = Q.hybrid_search(sparse, dense, _linked(spark, d), 10)
    return Q.retrieval_state(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), found.withColumn("partial", F.col("query_id") % 7 == 0))


def rerank_hits(spark, d):
    """The first five keyword hits by the length of their text, and without a scorer."""
    hits = base._hits(spark, d).select("query_id", "query", F.col("chunk_id").alias("id"), "content", "rank")
    made = lambda score, name: Q.rerank(hits, score, 5).select("query_id", "id", F.lit(name).alias("scorer"), "rerank", "rerank_score", "partial")
    return made(lambda queries, texts: [len(t) for t in texts], "length").unionByName(made(None, "none"))


def document_lookups(spark, d):
    """The two best sources of each question, with a heading, the sentence that holds it or the first sentence."""
    hits = base._hits(spark, d).withColumn("heading", F.when(F.col("chunk_id") % 3 == 0, F.col("document_id")).when(F.col("chunk_id") % 3 == 1, "")).withColumn("title", F.reverse("document_id"))
    found = Q.document_lookup(hits, 2)
    return found.select("query_id", "document_id", "best_chunk", "score", "reason", "rank")


def document_contexts(spark, d):
    """The three best sources of each question, their fields and their passages as one block of text."""
    groups = Q.top_per_query(Q.group_by_document(base._hits(spark, d)), 3, ["query_id"], tie="document_id")
    contents = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("about "), "source").alias("title"), F.col("lang").alias("document_type"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("page"), F.translate("text", "\n\t\r", "   ").alias("content"))
    return Q.document_context(groups, contents)


def expanded_queries(spark, d):
    """Questions with a name and a mention, of which some are absent or the same."""
    text = F.col("text")
    first = F.substring_index(text, " ", 2)
    plans = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"), F.when(F.col("item_id") % 2 == 0, first).alias("resolved"), F.when(F.col("item_id") % 3 == 0, F.substring_index(text, " ", 1)).otherwise(first).alias("mention"))
    return L.expand_queries(plans)


def question_kinds(spark, d):
    """Customers' names in questions of each kind."""
    name = F.col("c_name")
    shapes = [(" kimdir?",), (" hakkında neler biliyoruz?",), (" hangi belgelerde geçiyor?",), ("'nin kaç adet tapusu var?",), (" hangi malları var?",), (" 1995-1998",), (" who is",), (" nerede",)]
    text = F.lit(None).cast("string")
    for i, (end,) in enumerate(shapes):
        text = F.when(F.col("c_custkey") % len(shapes) == i, F.concat(name, F.lit(end))).otherwise(text)
    found = L.tag_queries(_t(spark, d, "customer").withColumn("question", text), "c_custkey", "question")
    return found.select("query_id", "operation", "exhaustive", "mention", "date_start", "date_end")


def mirrored_vectors(spark, d):
    """Brands as vectors of their name, with the nations that their suppliers are from."""
    part, line = _t(spark, d, "part"), _t(spark, d, "lineitem")
    artifacts = part.groupBy(F.col("p_brand").alias("artifact_id")).agg(F.collect_list("p_partkey").alias("unit_ids"), F.min("p_name").alias("text"))
    units = line.groupBy(F.col("l_partkey").alias("unit_id")).agg(F.collect_set("l_suppkey").alias("document_ids"))
    documents = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_nationkey").alias("logical_id"))
    from marginalia.operators.build import mirror_vectors

    found = mirror_vectors(artifacts, units, documents, lambda texts: [[len(t), t.count("a")] for t in texts], 2, "h", {"workspace_id": "w"})
    return found.select("artifact_id", F.concat_ws(",", F.transform("logical_ids", lambda x: x.cast("string"))).alias("nations"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def built_projections(spark, d):
    """The indexes of a snapshot, sparse and dense, as they were written."""
    from marginalia.operators.build import build_projections
    from marginalia.sources.session import shared_folder

    folder = shared_folder(spark, "projections")
    docs = _t(spark, d, "documents").select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content")).where("workspace_id is not null")
    build_projections(docs, folder, "g1", lambda texts: [[len(t)] for t in texts], 1, "h")
    read = lambda part: spark.read.parquet(f"{folder}/{part}")
    dense = read("dense").groupBy("workspace_id", "generation_id").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.get("embedding", F.lit(0))).cast("long").alias("numbers"))
    sparse = read("sparse/postings").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))
    return dense.join(sparse, "workspace_id").join(read("sparse/statistics").select("workspace_id", "n"), "workspace_id")


def embedded_corpus(spark, d):
    """Documents embedded by their length and blanks; the function takes no more than five texts at once, so batches are halved."""

    def embed(texts):
        if len(texts) > 5:
            raise ValueError("too many")
        return [[len(t), t.count(" ")] for t in texts]

    found = C.embed_corpus(_t(spark, d, "documents"), embed, "doc_id", "text", 2)
    return found.select(F.col("id").alias("doc_id"), F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_blanks"))


def _valid(spark, d):
    """Each document as evidence of its source under two ids, where it is even; numbers ending in 3 are of another generation."""
    docs = _t(spark, d, "documents")
    copies = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = docs.select(F.col("source").alias("package_id"), "doc_id", "text", "lang", F.explode(copies).alias("copy"))
    evidence = rows.select(
        "package_id", F.concat("copy", F.col("doc_id").cast("string")).alias("evidence_id"), F.concat("lang", "copy").alias("step_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("version_id"),
        F.when(F.col("doc_id") % 10 == 3, "g0").otherwise("g1").alias("generation_id"), F.lit(2).alias("start_offset"), F.substring("text", 3, 5).alias("source_text"),
        F.when(F.col("copy") == "a", 0.25).otherwise(0.75).alias("relevance"), ((F.col("doc_id") % 8) / 8).alias("quality"),
    )
    return E.validate_evidence(evidence, docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("version_id"), F.col("text").alias("content")), "g1")


def merged_spans(spark, d):
    """Evidence of one span under two ids is one row with both, the best scores and all steps."""
    valid, issues = _valid(spark, d)
    rows = valid.select("package_id", "evidence_id", F.concat_ws(",", "aliases").alias("aliases"), "relevance", F.concat_ws(",", "steps").alias("steps"), F.lit(None).cast("string").alias("issue"))
    return rows.unionByName(issues.select("package_id", "evidence_id", "issue"), allowMissingColumns=True)


def provenance_links(spark, d):
    """Languages of a source as artifacts, linked to all evidence of their documents."""
    valid, _ = _valid(spark, d)
    ids = F.array(F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.concat(F.lit("b"), F.col("doc_id").cast("string")))
    links = _t(spark, d, "documents").groupBy(F.col("source").alias("package_id"), F.col("lang").alias("artifact_id")).agg(F.flatten(F.collect_list(ids)).alias("evidence_ids"))
    found = E.valid_links(links, valid)
    return found.select("package_id", "artifact_id", F.size("evidence_ids").alias("n"), F.md5(F.concat_ws(",", "evidence_ids")).alias("ids_md5"))


def audited_citations(spark, d):
    """Answers with markers in and out of order, repeated, of one chunk, out of range and without any."""
    k, text = F.col("turn") % 6, F.translate("text", "[]", "()")
    content = (
        F.when(k == 0, F.concat(text, F.lit(" [2] and [1]."))).when(k == 1, F.concat(F.lit("[3]"), text, F.lit("[3][1]"))).when(k == 2, F.concat(text, F.lit(" [5]"))).when(k == 3, text)
        .when(k == 4, F.concat(F.lit("[4][2] "), text, F.lit(" [1] [2]"))).otherwise(F.concat(text, F.lit("[1][99999999999]")))
    )
    cited = F.array(*[F.struct(F.lit(doc).alias("document_id"), F.lit(chunk).alias("chunk_id"), F.lit(label).alias("label")) for doc, chunk, label in (("d", "1", "a"), ("d", "2", "b"), ("e", "1", "c"), ("d", "1", "again"))])
    rows = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), content.alias("content"), cited.alias("citations"))
    return E.audit_citations(rows).select("message_id", "content", F.array_join("citations.label", ",").alias("citations"), "accepted")


def citation_summary(spark, d):
    """Five counts of each turn's answer, of which every other tells what was selected."""
    k = F.col("turn") % 3
    content = F.when(k == 0, "x [2] y [1]").when(k == 1, "[7]").otherwise("[2] and [2]")
    cited = F.array(*[F.struct(F.lit("d").alias("document_id"), F.lit(x).alias("chunk_id")) for x in ("1", "2")])
    rows = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), content.alias("content"), cited.alias("citations"), "turn")
    told = rows.where("turn % 2 = 0").select("message_id", (F.col("turn") + 5).alias("input_count"), F.when(F.col("turn") > 0, F.col("turn")).alias("selected_count"))
    return E.citation_summary(E.audit_citations(rows), told)


def readable_sources(spark, d):
    """Every document as it is cited: with its version and, if it has one, its section."""
    docs = _t(spark, d, "documents")
    name = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), name("v").alias("version_id"), name("l").alias("logical_id"))
    documents = docs.select(F.col("source").alias("document_id")).distinct().withColumn("document_title", F.upper("document_id"))
    logical = docs.where("doc_id % 4 = 0").select(name("l").alias("logical_id"), F.col("lang").alias("section"))
    versions = docs.select(name("v").alias("version_id"), F.concat("lang", F.lit(".txt")).alias("source_filename"))
    return E.readable_source(chunks.select("chunk_id"), chunks, documents, versions, logical).select("chunk_id", "document_title", "source_filename", "section")


def source_details(spark, d):
    """Documents as passages with a line that says where they are."""
    from marginalia.operators.build import source_details as details

    docs = _t(spark, d, "documents")
    k = F.col("doc_id")
    name = lambda kind: F.concat(F.lit(kind), k.cast("string"))
    chunks = docs.select(k.alias("chunk_id"), F.col("source").alias("document_id"), name("v").alias("version_id"), name("l").alias("logical_id"), (k % 7).alias("ordinal"))
    logical = docs.where("doc_id % 3 > 0").select(name("l").alias("logical_id"), F.col("lang").alias("title"), F.when(k % 3 == 1, k).alias("page_start"), F.when(k % 3 == 1, k + k % 2).alias("page_end"))
    found = details(chunks, docs.select(F.col("source").alias("document_id"), F.col("source").alias("title")).distinct(), docs.select(name("v").alias("version_id"), F.lit("f.txt").alias("source_filename")), logical)
    return found.select("chunk_id", "title", "source_filename", "section", "location")


def artifact_evidence(spark, d):
    """Brands with their parts as evidence, each id given twice."""
    part = _t(spark, d, "part")
    artifacts = part.groupBy(F.col("p_brand").alias("artifact_id")).agg(F.flatten(F.collect_list(F.array("p_partkey", "p_partkey"))).alias("evidence_ids"))
    return G.artifact_evidence(artifacts, part.where("p_size > 20").select(F.col("p_partkey").alias("evidence_id"), "p_type")).select("artifact_id", "evidence_id", "p_type")


def evidence_chains(spark, d):
    """Lines as evidence of orders, of customers, of nations, of regions; some links are missing."""
    evidence = _t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.col("l_orderkey").alias("chunk_id"))
    chunks = _t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("logical_id"))
    logical = _t(spark, d, "customer").select(F.col("c_custkey").alias("logical_id"), F.col("c_nationkey").alias("version_id"))
    versions = _t(spark, d, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("version_id"), F.col("n_regionkey").alias("document_id"))
    found = G.evidence_chain(evidence, chunks, logical, versions, _t(spark, d, "region").select(F.col("r_regionkey").alias("document_id"), "r_name"))
    return found.select("evidence_id", "logical_id", "version_id", "r_name")


def looked_up_entities(spark, d):
    """Parts of one generation by id, with the suppliers that speak for them."""
    entities = _t(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), "p_name", F.when(F.col("p_partkey") % 3 == 0, "g0").otherwise("g1").alias("generation_id"))
    evidence = _t(spark, d, "lineitem").where("l_suppkey < 20").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("evidence_id"))
    ids = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entity_id"))
    found = G.lookup_entities(entities, ids, evidence, "g1")
    return found.select("entity_id", "p_name", F.concat_ws(",", F.transform("evidence_ids", lambda x: x.cast("string"))).alias("evidence_ids"))


def graph_sample(spark, d):
    """The first customers and nations as nodes, and the edges between them."""
    c = _t(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("node")).unionByName(_t(spark, d, "nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("node")))
    edges = c.select(F.concat(F.lit("e"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("edge_id"), F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("source"), F.concat(F.lit("a"), F.col("c_nationkey").cast("string")).alias("target"))
    kept, inside = G.graph_sample(nodes, edges, 150, 100)
    return kept.select(F.lit("node").alias("kind"), F.col("node").alias("id")).unionByName(inside.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, stage_rankings, retrieval_states, rerank_hits, document_lookups, document_contexts, expanded_queries, question_kinds, mirrored_vectors,
        built_projections, embedded_corpus, merged_spans, provenance_links, audited_citations, citation_summary, readable_sources, source_details,
        artifact_evidence, evidence_chains, looked_up_entities, graph_sample,
    )
}

_FUSED = f"""{_BM25}, {_KEYWORD}, sparse AS (SELECT query_id, id, rank FROM bm25 WHERE rank <= 10 AND score > 0),
u AS (SELECT * FROM sparse UNION ALL SELECT query_id, id, rank FROM keyword),
f AS (SELECT query_id, id, round(sum(1 / (rank + 60.0::DOUBLE)), 9) AS rrf_score FROM u GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM f) WHERE rank <= 10)"""
_EXPANDED = f"""{_FUSED}, d AS (SELECT doc_id, source FROM documents), h AS (SELECT query_id, chunk_id, source, rank FROM fused JOIN d ON doc_id = chunk_id),
e AS (SELECT query_id, chunk_id, 0 AS level, rank, 0 AS place FROM h UNION ALL SELECT query_id, d.doc_id, 1, rank, 0 FROM h JOIN d ON d.doc_id = chunk_id - 20 AND d.source = h.source
      UNION ALL SELECT query_id, d.doc_id, 1, rank, 1 FROM h JOIN d ON d.doc_id = chunk_id + 20 AND d.source = h.source),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, level, place) AS r FROM e),
expanded AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, level, place) AS position FROM o WHERE r = 1)"""
_RERANKED = "reranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, position) AS position FROM expanded JOIN documents ON doc_id = chunk_id WHERE position <= 12)"
_HITS = f"""{_KEYWORD}, hits AS (SELECT k.query_id, k.id, k.score, k.rank, d.source, d.text, b.text AS query, contains(lower(d.text), lower(b.text)) AS exact FROM keyword k JOIN documents d ON d.doc_id = k.id JOIN benchmark b ON b.item_id = k.query_id),
groups AS (SELECT query_id, source AS document_id, (list(id ORDER BY exact DESC, score DESC, id))[1] AS best_chunk, round(max(score) + max(exact::INT), 6) AS score, list(id ORDER BY exact DESC, score DESC, id) AS chunks FROM hits GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM groups)"""
_SPANS = """sp AS (SELECT source, doc_id, lang, doc_id % 2 = 0 AS two FROM documents WHERE doc_id % 10 <> 3)"""

ORACLE = {
    "hybrid_search": f"WITH {_EXPANDED}, {_RERANKED} SELECT query_id, chunk_id, position, false AS partial FROM reranked WHERE position <= 8",
    "stage_rankings": f"""WITH {_EXPANDED}, {_RERANKED} SELECT query_id, 'sparse' AS stage, id, rank::INT AS rank FROM sparse UNION ALL SELECT query_id, 'dense', id, rank FROM keyword UNION ALL SELECT query_id, 'fused', chunk_id, rank FROM fused
        UNION ALL SELECT query_id, 'expanded', chunk_id, position FROM expanded UNION ALL SELECT query_id, 'reranked', chunk_id, position FROM reranked UNION ALL SELECT query_id, 'final', chunk_id, position FROM reranked WHERE position <= 8""",
    "retrieval_states": f"""WITH {_FUSED}, qs AS (SELECT DISTINCT query_id FROM sparse WHERE query_id % 3 <> 0 UNION SELECT query_id FROM keyword WHERE query_id % 5 <> 0)
        SELECT item_id AS query_id, CASE WHEN item_id NOT IN (SELECT query_id FROM qs) THEN 'unsupported' WHEN item_id % 7 = 0 THEN 'partial' ELSE 'grounded' END AS state FROM benchmark""",
    "rerank_hits": f"""WITH {_HITS}, t AS (SELECT * FROM hits WHERE rank <= 5)
        SELECT query_id, id, 'length' AS scorer, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) AS rerank, length(text)::DOUBLE AS rerank_score, false AS partial FROM t
        UNION ALL SELECT query_id, id, 'none', rank, NULL, true FROM t""",
    "document_lookups": f"""WITH {_HITS}, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reverse(document_id), document_id) AS place FROM groups),
        s AS (SELECT p.*, h.query, string_split(regexp_replace(regexp_replace(trim(h.text), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS parts FROM pl p JOIN hits h ON h.query_id = p.query_id AND h.id = p.best_chunk WHERE place <= 2),
        t AS (SELECT *, coalesce(list_filter(parts, lambda x: trim(query) <> '' AND contains(lower(x), lower(trim(query))))[1], parts[1]) AS said FROM s)
        SELECT query_id, document_id, best_chunk, score, CASE WHEN best_chunk % 3 = 0 THEN document_id WHEN length(said) <= 160 THEN said ELSE rtrim(left(said, 157)) || '…' END AS reason, place AS rank FROM t""",
    "document_contexts": f"""WITH {_HITS}, c AS (SELECT query_id, rank, document_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS turn FROM placed WHERE rank <= 3),
        b AS (SELECT query_id, rank, concat_ws(chr(10), 'Document', 'document_id: ' || document_id, 'document_code: ', 'title: about ' || document_id, 'page: ' || arg_min(CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END, turn), 'source_original: ', 'document_type: ' || arg_min(lang, turn),
          'matching_chunks:', string_agg('- ' || trim(translate(text, chr(10) || chr(9) || chr(13), '   ')), chr(10) ORDER BY turn)) AS t FROM c JOIN documents ON doc_id = chunk GROUP BY query_id, rank, document_id)
        SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY 1""",
    "expanded_queries": """WITH p AS (SELECT item_id, text AS a, CASE WHEN item_id % 2 = 0 THEN array_to_string(string_split(text, ' ')[:2], ' ') END AS b, array_to_string(string_split(text, ' ')[:CASE WHEN item_id % 3 = 0 THEN 1 ELSE 2 END], ' ') AS c FROM benchmark),
        l AS (SELECT item_id, list_concat([a], CASE WHEN b IS NULL OR b = a THEN [] ELSE [b] END, CASE WHEN c = a OR c = b THEN [] ELSE [c] END) AS l FROM p)
        SELECT item_id AS query_id, (unnest(range(0, len(l))))::INT AS turn, unnest(l) AS text FROM l""",
    "question_kinds": """WITH k AS (SELECT c_custkey, c_name, c_custkey % 8 AS k FROM customer)
        SELECT c_custkey AS query_id, CASE k WHEN 0 THEN 'identify' WHEN 1 THEN 'describe' WHEN 2 THEN 'lookup_documents' WHEN 3 THEN 'count' WHEN 4 THEN 'list' WHEN 5 THEN 'timeline' WHEN 6 THEN 'identify' ELSE 'generic_qa' END AS operation, k IN (3, 4) AS exhaustive,
        c_name || CASE k WHEN 5 THEN ' 1995-1998' WHEN 6 THEN ' who is' WHEN 7 THEN ' nerede' ELSE '' END AS mention, CASE WHEN k = 5 THEN '1995' END AS date_start, CASE WHEN k = 5 THEN '1998' END AS date_end FROM k""",
    "mirrored_vectors": """WITH b AS (SELECT p_brand, min(p_name) AS t FROM part GROUP BY 1), n AS (SELECT DISTINCT p_brand, s_nationkey AS k FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey)
        SELECT p_brand AS artifact_id, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k), '') AS nations, length(any_value(t))::DOUBLE AS x, (length(any_value(t)) - length(replace(any_value(t), 'a', '')))::DOUBLE AS y FROM b LEFT JOIN n USING (p_brand) GROUP BY 1""",
    "built_projections": r"""WITH t AS (SELECT lang, doc_id, length(source || chr(10) || text) AS n, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents WHERE lang IS NOT NULL)
        SELECT lang AS workspace_id, 'g1' AS generation_id, count(*) AS vectors, sum(n)::BIGINT AS numbers, sum(len(list_distinct(w)))::BIGINT AS postings, sum(len(w))::BIGINT AS tokens, count(*) AS n FROM t GROUP BY 1""",
    "embedded_corpus": "SELECT doc_id, length(text)::DOUBLE AS n_chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_blanks FROM documents",
    "merged_spans": f"""WITH {_SPANS} SELECT source AS package_id, 'a' || doc_id AS evidence_id, 'a' || doc_id || CASE WHEN two THEN ',b' || doc_id ELSE '' END AS aliases, CASE WHEN two THEN 0.75 ELSE 0.25 END::DOUBLE AS relevance,
        coalesce(lang || 'a' || CASE WHEN two THEN ',' || lang || 'b' ELSE '' END, '') AS steps, NULL AS issue FROM sp
        UNION ALL SELECT source, 'a' || doc_id, NULL, NULL, NULL, 'other_generation' FROM documents WHERE doc_id % 10 = 3""",
    "provenance_links": f"""WITH {_SPANS} SELECT source AS package_id, lang AS artifact_id, count(*)::INT AS n, md5(string_agg('a' || doc_id, ',' ORDER BY 'a' || doc_id)) AS ids_md5 FROM sp GROUP BY 1, 2""",
    "audited_citations": """WITH c AS (SELECT conv_id || '-' || turn AS message_id, turn % 6 AS k, translate(text, '[]', '()') AS t FROM conversations)
        SELECT message_id, CASE k WHEN 0 THEN t || ' [1] and [2].' WHEN 1 THEN '[1]' || t || '[1][2]' WHEN 2 THEN t || ' [5]' WHEN 3 THEN t WHEN 4 THEN '[1][2] ' || t || ' [1] [2]' ELSE t || '[1][99999999999]' END AS content,
        CASE k WHEN 0 THEN 'b,a' WHEN 1 THEN 'c,a' WHEN 4 THEN 'again,b' ELSE '' END AS citations, k IN (0, 1, 4) AS accepted FROM c""",
    "citation_summary": """WITH c AS (SELECT conv_id || '-' || turn AS message_id, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS cited, CASE WHEN turn % 2 = 0 THEN turn + 5 END AS given, CASE WHEN turn % 2 = 0 AND turn > 0 THEN turn END AS chosen FROM conversations),
        s AS (SELECT *, coalesce(chosen, cited)::BIGINT AS selected FROM c)
        SELECT message_id, coalesce(given, selected)::BIGINT AS retrieval_candidate_count, selected AS selected_evidence_count, cited::BIGINT AS cited_evidence_count, cited::BIGINT AS user_visible_source_count, greatest(0, selected - cited)::BIGINT AS unused_selected_evidence_count FROM s""",
    "readable_sources": "SELECT doc_id AS chunk_id, upper(source) AS document_title, lang || '.txt' AS source_filename, CASE WHEN doc_id % 4 = 0 THEN lang END AS section FROM documents",
    "source_details": """SELECT doc_id AS chunk_id, source AS title, 'f.txt' AS source_filename, CASE WHEN doc_id % 3 > 0 THEN lang END AS section,
        concat_ws(', ', CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN 'p. ' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '-' || (doc_id + 1) ELSE '' END END, 'passage ' || (doc_id % 7 + 1)) AS location FROM documents""",
    "artifact_evidence": "SELECT p_brand AS artifact_id, p_partkey AS evidence_id, p_type FROM part WHERE p_size > 20",
    "evidence_chains": """SELECT l_orderkey || '-' || l_linenumber AS evidence_id, o_custkey AS logical_id, n_nationkey AS version_id, r_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        WHERE o_orderstatus <> 'P' AND n_nationkey <> 7""",
    "looked_up_entities": """WITH v AS (SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS x, list_sort(list_distinct(list(l_suppkey))) AS l FROM lineitem WHERE l_suppkey < 20 GROUP BY 1)
        SELECT p_partkey AS entity_id, p_name, coalesce(array_to_string(l, ','), '') AS evidence_ids FROM part LEFT JOIN v ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
    "graph_sample": """WITH n AS (SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS id FROM customer UNION ALL SELECT 'a' || n_nationkey FROM nation ORDER BY 1 LIMIT 150)
        SELECT 'node' AS kind, id FROM n UNION ALL (SELECT 'edge', 'e' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer WHERE 'c' || lpad(c_custkey::VARCHAR, 9, '0') IN (SELECT id FROM n) AND 'a' || c_nationkey IN (SELECT id FROM n) ORDER BY c_custkey LIMIT 100)""",
}
