"""Queries of sources and sinks, each written and read back, and of shared expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import corpus as C
from marginalia.operators import knowledge as K
from marginalia.operators import logs as L
from marginalia.operators import property as P
from marginalia.operators import relational as R
from marginalia.operators import retrieval as Q
from marginalia.sources import tables as S
from marginalia.sources.session import shared_folder
from marginalia.sources.store import Store


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gone(spark, d, name="document_id"):
    return _t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias(name)).distinct()


def _versions(spark, d):
    """Documents with one version each; those of low quality are deleted."""
    docs = _t(spark, d, "documents")
    named = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"), "source", "text")
    documents = named.select("document_id", F.col("version_id").alias("active_version_id"), F.col("source").alias("title")).join(_gone(spark, d).withColumn("deleted_at", F.lit("2026-01-01")), "document_id", "left")
    return documents, named.select("version_id", F.col("text").alias("content")), named


def active_sections(spark, d):
    """Two sections for two documents of three; a third stands for itself."""
    documents, versions, named = _versions(spark, d)
    logical = named.where("document_id % 3 <> 0").select("document_id", "version_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part"), "source")
    logical = logical.select("document_id", "version_id", F.concat_ws("-", "version_id", "part").alias("logical_id"), F.col("part").alias("title"), F.concat_ws("/", "part", "source").alias("content"))
    found = S.active_logical_documents(logical, versions, documents)
    return found.select("document_id", "logical_id", "title", F.md5("content").alias("content_md5"))


def text_files(spark, d):
    """Text files of the documents of a source, by their ids, with foreign line ends; those of one source are blank and so rejected.

    A task writes whole parts, so that the commit moves a folder a part, and the files are listed by parts, not one by one.
    """
    folder = shared_folder(spark, "texts")
    line = F.when(F.col("source") == "src0", "  ").otherwise(F.concat("text", F.lit("\r")))
    part = F.floor(F.col("doc_id") / 400)
    rows = _t(spark, d, "documents").select(part.alias("part"), "source", "doc_id", line.alias("line"))
    rows.repartition("part").sortWithinPartitions("part", "source", "doc_id").select("part", "source", "line").write.partitionBy("part", "source").text(folder)
    files = S.read_texts(spark, folder)
    place = [F.regexp_extract("path", f"{x}=([^/]+)/", 1).alias(x) for x in ("source", "part")]
    return files.select(*place, F.coalesce("reason", F.lit("accepted")).alias("state"), F.when(F.col("reason").isNull(), F.col("text")).alias("text"))


def media_types(spark, d):
    """Pages as files with declared types, of which texts may have three."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(k == 4, ".exe").when(k < 2, ".md").otherwise(".txt"))
    kind = F.when(k == 0, "text/markdown").when(k == 1, "text/html").when(k == 2, "TEXT/PLAIN")
    files = _t(spark, d, "pages").select(name.alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"), kind.alias("media_type"))
    return S.classify_files(files).select("path", "accepted", "reason")


def newest_artifacts(spark, d):
    """Suppliers written twice under names that begin with a date; the later file is read."""
    folder = shared_folder(spark, "artifacts")
    supplier = _t(spark, d, "supplier")
    for run, rows in (("20240101", supplier), ("20240301", supplier.where("s_nationkey < 10"))):
        rows.coalesce(1).write.parquet(f"{folder}/{run}_entities.parquet")
    place = S.newest_artifact(spark, folder, "part-")
    found = S.read_graph_artifacts(spark, place, "entities", ["id", "s_suppkey"], ["description", "s_name"])
    return found.select("id", "kind", "text", F.col("attributes")["s_nationkey"].alias("nation"))


def json_artifacts(spark, d):
    """Suppliers as JSON arrays, one a nation; some without attributes."""
    folder = shared_folder(spark, "json")
    some = F.when(F.col("s_suppkey") % 3 > 0, F.map_from_arrays(F.array(F.lit("nation")), F.array(F.col("s_nationkey").cast("string"))))
    row = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("text"), some.alias("attributes"))
    _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(row)).alias("value")).select("value").repartition(25).write.text(folder)
    return S.read_json_artifacts(spark, folder, "supplier").select("id", "kind", "text", F.col("attributes")["nation"].alias("nation"), F.size("attributes").alias("n"))


def source_manifest(spark, d):
    """Two generations of one snapshot, the second with the English documents replaced."""
    folder = shared_folder(spark, "manifest")
    docs = _t(spark, d, "documents").select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.lit("v1").alias("version_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    S.write_manifest(docs, folder, "g1")
    S.write_manifest(docs.where("workspace_id = 'en'"), folder, "g2")
    S.write_manifest(docs.where("workspace_id = 'en' and document_id % 2 = 0"), folder, "g2")
    return spark.read.parquet(folder).select("workspace_id", "generation_id", "document_id", "content_hash")


def scoped_index(spark, d):
    """The index of one workspace out of all, read back."""
    folder = shared_folder(spark, "index")
    docs = _t(spark, d, "documents").select(F.col("lang").alias("workspace_id"), "doc_id", "text").where("workspace_id is not null")
    S.write_index(*Q.bm25_index(docs, "doc_id", "text", ["workspace_id"]), folder, ["workspace_id"])
    postings, stats = S.read_index(spark, folder, {"workspace_id": "en"})
    terms = postings.groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return terms.join(stats.select("workspace_id", "n", F.round("mean_length", 4).alias("mean_length")), "workspace_id").select("term", "df", "tf", "n", "mean_length")


def vector_upsert(spark, d):
    """Even points, then every third in two versions, of which the later counts, put into a store; the second put is retried."""
    points = _t(spark, d, "embeddings").select(F.col("label").alias("workspace_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("h").alias("config_hash"))
    scope, key = ["workspace_id"], ["chunk_id"]
    size, store = points.select(F.size("embedding")).first()[0], Store(spark, shared_folder(spark, "vectors"))
    S.store_vectors(store, 0, points.where("chunk_id % 2 = 0").withColumn("version", F.lit(1)), size, "h", scope, key)
    more = points.where("chunk_id % 3 = 0").withColumn("version", F.explode(F.array(F.lit(3), F.lit(2))))
    for version in (F.col("version"), F.lit(9)):  # the retry has nothing to say
        S.store_vectors(store, 1, more.withColumn("version", version), size, "h", scope, key)
    return store.read("vectors").select("point_id", "chunk_id", "version")


def corpus_text(spark, d):
    """Documents as text with a header, read back as lines."""
    folder = shared_folder(spark, "corpus")
    S.write_corpus_text(_t(spark, d, "documents").select("doc_id", "lang", F.translate("text", "\n\r", "  ").alias("content")), folder, ["doc_id", "lang"])
    return spark.read.text(folder).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def stored_graph(spark, d):
    """Suppliers and their nations as a graph, written under a generation and read back; nations are ends without a row."""
    folder = shared_folder(spark, "graph")
    supplier = _t(spark, d, "supplier")
    entities = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("text"), F.create_map(F.lit("title"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("attributes"))
    ends = F.create_map(F.lit("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("target"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    S.write_graph(*S.graph_tables(entities, supplier.select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("in").alias("text"), ends.alias("attributes"))), folder, "g1")
    nodes, edges = S.read_graph(spark, folder, "g1")
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id"), "text").unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), "text"))


def replaced_layer(spark, d):
    """Two generations of nations and customers; the second is replaced by fewer customers, both tables at once."""
    store = Store(spark, shared_folder(spark, "layer"))
    nodes = lambda c: c.select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("node")).distinct())
    edges = lambda c: c.select(F.concat(F.lit("e"), "c_custkey").alias("edge_id"), F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    customer = _t(spark, d, "customer")
    for number, (generation, rows) in enumerate((("g1", customer), ("g2", customer), ("g2", customer.where("c_acctbal > 0")))):
        K.store_extracted(store, number, nodes(rows).withColumn("generation_id", F.lit(generation)), edges(rows), generation)
    count = lambda name: store.read(name).groupBy("generation_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return count("nodes").unionByName(count("edges"))


def layer_issues(spark, d):
    """Orders as nodes and lines as edges with all four faults."""
    orders, lines = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    nodes = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "P", "g0").otherwise("g1").alias("generation_id"))
    nodes = nodes.unionByName(nodes.where("node % 7 = 0"))
    edges = lines.select(F.concat_ws("-", "l_orderkey", F.least("l_linenumber", F.lit(2))).alias("edge_id"), F.col("l_orderkey").alias("source"), F.col("l_orderkey").alias("target"))
    return K.extracted_issues(nodes, edges, "g1").groupBy("issue", "id").agg(F.count(F.lit(1)).alias("n"))


def tombstone_cascade(spark, d):
    """Documents of low quality with their versions, sections and chunks; some were deleted before."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    old = F.when(F.col("document_id") % 4 == 0, F.lit("2020-01-01").cast("timestamp"))
    name = lambda kind: F.concat(F.lit(kind), F.col("document_id").cast("string"))
    versions = docs.select(name("v").alias("version_id"), "document_id")
    logical = docs.select(name("l").alias("logical_id"), name("v").alias("version_id"))
    chunks = docs.select(F.explode(F.array(F.concat(name("c"), F.lit("-0")), F.concat(name("c"), F.lit("-1")))).alias("chunk_id"), name("v").alias("version_id"))
    made = R.mark_cascade(docs.withColumn("deleted_at", old), versions, logical, chunks, _gone(spark, d), F.lit("2026-01-01").cast("timestamp"))
    every = None
    for kind, key, table in zip(("document", "version", "section", "chunk"), ("document_id", "version_id", "logical_id", "chunk_id"), made):
        rows = table.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.date_format("deleted_at", "yyyy").alias("deleted"))
        every = rows if every is None else every.unionByName(rows)
    return every


def stable_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("id"))


def embedding_texts(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return _t(spark, d, "documents").select("doc_id", F.md5(T.embedding_text(title, F.col("lang"), F.col("text"))).alias("text_md5"))


def match_reasons(spark, d):
    """The fifth word of each text, sought in its sentences where it has no heading, or an empty one."""
    docs = _t(spark, d, "documents").select("doc_id", "text", F.get(F.split("text", " "), F.lit(4)).alias("word"))
    heading = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("On "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 4 == 1, F.lit(""))
    return docs.select("doc_id", T.match_reason(heading, F.col("text"), F.coalesce("word", F.lit(""))).alias("reason"))


def year_ranges(spark, d):
    """Order dates as a range, as one year, and without a year."""
    year = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("from "), year, F.lit(" - 2001, paid"))).when(k == 1, F.concat(F.lit("in "), year, F.lit(" of 3000"))).otherwise(F.concat(F.lit("x"), year))
    return _t(spark, d, "orders").select("o_orderkey", T.year_range(text).alias("y")).select("o_orderkey", F.col("y.start").alias("date_start"), F.col("y.end").alias("date_end"))


def id_lists(spark, d):
    """Part and supplier of each line as a JSON array, and as a loose list."""
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('"]'))).otherwise(F.concat(F.lit("['"), a, F.lit("'  "), b, F.lit(" ]")))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", T.id_list(text)).alias("ids"))


def folder_paths(spark, d):
    """Paths of the pages' addresses, some with parts that lead elsewhere."""
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    k = F.col("page_id") % 4
    odd = F.when(k == 0, F.concat(path, F.lit("/.."))).when(k == 1, F.concat(F.lit(" "), path, F.lit(" "))).when(k == 2, F.concat(path, F.lit("//a"))).otherwise(path)
    return _t(spark, d, "pages").select("page_id", F.concat_ws(">", T.folder_parts(odd)).alias("parts"), T.folder_parts(odd).isNotNull().alias("ok"))


def token_kinds(spark, d):
    n = T.token_counts(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", n.getField("words").alias("words"), n.getField("alphabetic").alias("alphabetic"), n.getField("digits").cast("long").alias("digits"))


def composed_names(spark, d):
    """Texts with a letter taken apart into a letter and a mark, composed again."""
    return _t(spark, d, "documents").select("doc_id", T.normalized_mention(F.concat(F.lit(" "), "text", F.lit("  e\u0301"))).alias("name"))


def comparable_names(spark, d):
    """Customers with and without a title."""
    k = F.col("c_custkey") % 4
    name = F.concat(F.when(k == 0, " Dr. ").when(k == 1, "PROF ").when(k == 2, "Drake ").otherwise(""), "c_name", F.lit(" é "))
    return _t(spark, d, "customer").select("c_custkey", T.comparable_name(name).alias("name"))


def json_fields(spark, d):
    """A field of the events' payloads, some cut short."""
    payload = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", T.json_field(payload, "k").alias("k"), T.json_field(payload, "other").alias("other"))


def property_display(spark, d):
    """Customers as properties with some fields."""
    k = F.col("c_custkey")
    field = lambda n, c: F.when(k % n > 0, c.cast("string"))
    fields = F.struct(field(2, F.lit("Ankara")).alias("province"), F.lit(None).cast("string").alias("district"), field(3, F.lit("Köy")).alias("neighborhood"), field(5, k).alias("sheet"), field(7, k + 1).alias("block"), field(11, k + 2).alias("parcel"), field(13, k + 3).alias("independent_section"))
    return _t(spark, d, "customer").select("c_custkey", fields.alias("fields")).select("c_custkey", P.property_display().alias("line"))


def group_members(spark, d):
    return R.group_members(_t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 > 0, F.col("s_nationkey")).alias("nation")), ["nation"])


def union_lists(spark, d):
    """Customers of one segment, then those who owe, then all of a nation: each once, with the list it came from."""
    c = _t(spark, d, "customer")
    named = lambda rows, name: rows.select("c_custkey", F.lit(name).alias("list"), "c_acctbal")
    lists = [named(c.where("c_mktsegment = 'BUILDING'"), "segment"), named(c.where("c_acctbal < 0"), "debt"), named(c.where("c_nationkey = 3"), "nation")]
    return R.union_records(lists, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "list")


def curation_fingerprint(spark, d):
    return C.curation_fingerprint(_t(spark, d, "nation"), _t(spark, d, "region"), _t(spark, d, "customer").select("c_custkey", "c_name"))


def stage_fingerprint(spark, d):
    """Of two stages: the same rows give another fingerprint in another generation."""
    customer, supplier = _t(spark, d, "customer").select("c_custkey", "c_name"), _t(spark, d, "supplier").select("s_suppkey", "s_name")
    return C.stage_fingerprint(customer, "identity", "g1").unionByName(C.stage_fingerprint(customer, "identity", "g2")).unionByName(C.stage_fingerprint(supplier, "claims", "g1"))


def collect_evidence(spark, d):
    """The parts of each supplier's orders, from lines that carry two ids."""
    lines = _t(spark, d, "lineitem").select("l_suppkey", F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("o"), (F.col("l_orderkey") % 10).cast("string"))).alias("evidence_ids"))
    found = R.collect_evidence(lines, ["l_suppkey"], "evidence_ids")
    return found.select("l_suppkey", F.size("evidence_ids").alias("n"), F.md5(F.concat_ws(",", "evidence_ids")).alias("ids_md5"))


def stage_cost(spark, d):
    """Events as reports; errors report no cost."""
    reports = _t(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("event_type").alias("stage"), F.when(F.col("event_type") != "error", F.col("value")).alias("estimated_cost_usd"))
    return L.stage_cost(reports).select("workspace_id", "stage", F.round("cost", 4).alias("cost"))


def recent_documents(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("n_chars") % 100).alias("updated_at"))
    return L.recent_documents(docs.join(_gone(spark, d).withColumn("deleted_at", F.lit("x")), "document_id", "left")).select("document_id", "updated_at")


def workspace_states(spark, d):
    """Sources with their documents, chunks and the language of their last document as the state of a run."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("workspace_id"), F.lit(None).cast("string").alias("deleted_at"), "lang")
    chunks = docs.select("document_id", "workspace_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    return L.catalog_overview(docs, chunks, docs.select("workspace_id", F.col("lang").alias("state"), F.col("document_id").alias("at")))


def ingestion_levels(spark, d):
    """Nations as sections of their region, customers as chunks, segments as entities of which three are in the graph."""
    logical = _t(spark, d, "nation").select(F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("logical_id"), F.col("n_nationkey").alias("ordinal"))
    c = _t(spark, d, "customer")
    entities = c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("entity_id"))
    nodes = c.where("c_mktsegment > 'BUILDING'").select(F.col("c_mktsegment").alias("entity_id")).distinct()
    found = L.ingestion_report(logical, c.select(F.col("c_nationkey").alias("logical_id"), F.col("c_custkey").alias("chunk_id")), entities, nodes)
    return found.select("source_id", "n_sections", "n_chunks", "n_entities", "n_nodes", F.concat_ws(";", F.transform("sections", lambda s: F.concat_ws(",", *[s[k].cast("string") for k in ("logical_id", "n_chunks", "n_entities", "n_nodes")]))).alias("sections"))


def carried_periods(spark, d):
    """Turns that name a year; each knows the last three years that were named, its own too."""
    turns = _t(spark, d, "conversations").withColumn("entity_type", F.col("role")).withColumn("entity_id", F.lit(None).cast("string"))
    turns = turns.withColumn("period", F.when(F.length("text") % 2 == 0, (F.lit(1900) + F.length("text") % 100).cast("string")))
    return L.carry_focus(turns, period="period", periods=3).select("conv_id", "turn", F.concat_ws(",", "periods").alias("periods"))


def reasoning_cost(spark, d):
    """Lines as usage of two models, of which one prices its reasoning apart."""
    n = lambda c: F.col(c).cast("long")
    events = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("own").alias("provider"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("model"), n("l_quantity").alias("output_tokens"), F.lit(20).alias("reasoning_tokens"), (n("l_partkey") + 5).alias("input_tokens"), F.lit(5).alias("cached_input_tokens"))
    rates = _t(spark, d, "region").where("r_regionkey < 2").selectExpr("'own' provider", "if(r_regionkey = 0, 'a', 'b') model", "10D input", "1D cached", "20D output", "0D embedding", "if(r_regionkey = 0, 40D, null) reasoning")
    return L.price_usage(events, rates).select("l_orderkey", "l_linenumber", F.round(F.col("cost_amount").cast("double"), 8).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        active_sections, text_files, media_types, newest_artifacts, json_artifacts, source_manifest, scoped_index, vector_upsert, corpus_text, stored_graph,
        replaced_layer, layer_issues, tombstone_cascade, stable_ids, embedding_texts, match_reasons, year_ranges, id_lists, folder_paths, token_kinds,
        composed_names, comparable_names, json_fields, property_display, group_members, union_lists, curation_fingerprint, stage_fingerprint,
        collect_evidence, stage_cost, recent_documents, workspace_states, ingestion_levels, carried_periods, reasoning_cost,
    )
}

_DEL = "SELECT doc_id FROM labels WHERE quality = 0"
_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_WS = r"[ \t\n\x0B\f\r]"


def _digest(rows: str) -> str:
    """The digest of a set of rows in two levels, from a table x of their digests h."""
    return f"""x AS ({rows}), x1 AS (SELECT substr(h, 1, 3) AS a, sha256(string_agg(h, '' ORDER BY h)) AS h FROM x GROUP BY a, substr(h, 1, 6)),
        x2 AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM x1 GROUP BY a), x3 AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM x2)"""


def _stage(stage: str, generation: str, rows: str) -> str:
    return f"SELECT '{stage}' AS stage, '{stage}:' || sha256('{generation}:' || fingerprint) AS fingerprint FROM (WITH {_digest(rows)} SELECT * FROM x3)"


_CUSTOMER = "SELECT sha256(concat_ws(chr(31), c_custkey::VARCHAR, c_name)) AS h FROM customer"
_SUPPLIER = "SELECT sha256(concat_ws(chr(31), s_name, s_suppkey::VARCHAR)) AS h FROM supplier"

ORACLE = {
    "active_sections": f"""SELECT doc_id AS document_id, 'v' || doc_id || '-' || part AS logical_id, part AS title, md5(part || '/' || source) AS content_md5 FROM documents, (VALUES ('a'), ('b')) p(part) WHERE doc_id % 3 <> 0 AND doc_id NOT IN ({_DEL})
        UNION ALL SELECT doc_id, 'v' || doc_id, source, md5(text) FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN ({_DEL})""",
    "text_files": """SELECT source, (doc_id // 400)::VARCHAR AS part, CASE WHEN source = 'src0' THEN 'empty' ELSE 'accepted' END AS state, CASE WHEN source <> 'src0' THEN string_agg(text || chr(10), '' ORDER BY doc_id) END AS text FROM documents GROUP BY 1, 2""",
    "media_types": """SELECT '/in/' || page_id || CASE WHEN k = 4 THEN '.exe' WHEN k < 2 THEN '.md' ELSE '.txt' END AS path, k NOT IN (1, 4) AS accepted, CASE k WHEN 1 THEN 'media_type' WHEN 4 THEN 'extension' END AS reason FROM (SELECT page_id, page_id % 5 AS k FROM pages)""",
    "newest_artifacts": "SELECT s_suppkey::VARCHAR AS id, 'entities' AS kind, s_name AS text, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_nationkey < 10",
    "json_artifacts": "SELECT s_suppkey::VARCHAR AS id, 'supplier' AS kind, s_name AS text, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::VARCHAR END AS nation, (s_suppkey % 3 > 0)::INT AS n FROM supplier",
    "source_manifest": """SELECT lang AS workspace_id, 'g1' AS generation_id, doc_id AS document_id, sha256(text) AS content_hash FROM documents
        UNION ALL SELECT lang, 'g2', doc_id, sha256(text) FROM documents WHERE lang = 'en' AND doc_id % 2 = 0""",
    "scoped_index": f"""WITH t AS (SELECT doc_id, {_TOK} AS tokens FROM documents WHERE lang = 'en'), s AS (SELECT count(*) AS n, round(avg(len(tokens)), 4) AS mean_length FROM t),
        u AS (SELECT doc_id, unnest(tokens) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, any_value(n) AS n, any_value(mean_length) AS mean_length FROM u, s GROUP BY term""",
    "vector_upsert": """SELECT left(sha256(label || chr(31) || vec_id), 32) AS point_id, vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS version FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""",
    "corpus_text": """SELECT value, count(*) AS n FROM (SELECT unnest(['doc_id: ' || doc_id, 'lang: ' || lang, '', translate(text, chr(10) || chr(13), '  ')]) AS value FROM documents) GROUP BY value""",
    "stored_graph": """SELECT 'node' AS kind, 's' || s_suppkey AS id, s_name AS text FROM supplier UNION ALL SELECT DISTINCT 'node', 'n' || s_nationkey, NULL FROM supplier
        UNION ALL SELECT 'edge', 's' || s_suppkey || '>n' || s_nationkey, 'in' FROM supplier""",
    "replaced_layer": """WITH g AS (SELECT 'g1' AS g, * FROM customer UNION ALL SELECT 'g2', * FROM customer WHERE c_acctbal > 0)
        SELECT g AS generation_id, count(*) + count(DISTINCT c_nationkey) AS n, 'nodes' AS kind FROM g GROUP BY g UNION ALL SELECT g, count(*), 'edges' FROM g GROUP BY g""",
    "layer_issues": """WITH n AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS old FROM orders WHERE o_orderkey % 5 <> 0), e AS (SELECT l_orderkey AS k, l_orderkey || '-' || least(l_linenumber, 2) AS id FROM lineitem)
        SELECT 'duplicate_node' AS issue, k::VARCHAR AS id, 1 AS n FROM n WHERE k % 7 = 0 UNION ALL SELECT 'duplicate_edge', id, 1 FROM e GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'missing_end', id, 1 FROM e WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT 'other_generation', k::VARCHAR, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END FROM n WHERE old""",
    "tombstone_cascade": f"""WITH x AS (SELECT doc_id AS i, CASE WHEN doc_id IN ({_DEL}) THEN '2026' END AS y FROM documents)
        SELECT 'document' AS kind, i::VARCHAR AS id, CASE WHEN i % 4 = 0 THEN '2020' ELSE y END AS deleted FROM x UNION ALL SELECT 'version', 'v' || i, y FROM x UNION ALL SELECT 'section', 'l' || i, y FROM x
        UNION ALL SELECT 'chunk', 'c' || i || '-' || j, y FROM x, (VALUES (0), (1)) v(j)""",
    "stable_ids": "SELECT doc_id, left(sha256(source || chr(31) || doc_id || chr(31) || CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END), 32) AS id FROM documents",
    "embedding_texts": "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN source || chr(10) ELSE '' END || coalesce(lang || chr(10), '') || text) AS text_md5 FROM documents",
    "match_reasons": rf"""WITH w AS (SELECT doc_id, lower(trim(coalesce(string_split(text, ' ')[5], ''))) AS word, string_split(regexp_replace(regexp_replace(trim(text), '([.!?]){_WS}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents),
        s AS (SELECT *, coalesce(list_filter(parts, lambda x: word <> '' AND contains(lower(x), word))[1], parts[1]) AS said FROM w)
        SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'On ' || doc_id WHEN length(said) <= 160 THEN said ELSE rtrim(left(said, 157)) || '…' END AS reason FROM s""",
    "year_ranges": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate)::VARCHAR END AS date_start, CASE o_orderkey % 3 WHEN 0 THEN '2001' WHEN 1 THEN year(o_orderdate)::VARCHAR END AS date_end FROM orders""",
    "id_lists": "SELECT l_orderkey, l_linenumber, l_partkey || '|' || l_suppkey AS ids FROM lineitem",
    "folder_paths": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS p FROM pages), q AS (SELECT page_id, string_split(trim(CASE page_id % 4 WHEN 0 THEN p || '/..' WHEN 2 THEN p || '//a' ELSE p END), '/') AS l FROM p)
        SELECT page_id, CASE WHEN list_has_any(l, ['', '.', '..']) THEN '' ELSE array_to_string(l, '>') END AS parts, NOT list_has_any(l, ['', '.', '..']) AS ok FROM q""",
    "token_kinds": r"""SELECT doc_id, len(w)::INT AS words, len(list_filter(w, lambda x: regexp_full_match(x, '\p{L}+')))::INT AS alphabetic, len(regexp_extract_all(text, '[0-9]')) AS digits FROM (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents)""",
    "composed_names": rf"""SELECT doc_id, nfc_normalize(trim(regexp_replace(lower(' ' || text || '  e' || chr(769)), '{_WS}+', ' ', 'g'))) AS name FROM documents""",
    "comparable_names": """SELECT c_custkey, lower(nfc_normalize(CASE WHEN c_custkey % 4 = 2 THEN 'Drake ' ELSE '' END || c_name || ' e' || chr(769))) AS name FROM customer""",
    "json_fields": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k, NULL::VARCHAR AS other FROM events",
    "property_display": """WITH f AS (SELECT c_custkey AS k, concat_ws(', ', CASE WHEN c_custkey % 2 > 0 THEN 'Ankara' END, CASE WHEN c_custkey % 3 > 0 THEN 'Köy' END) AS place,
        concat_ws(', ', CASE WHEN c_custkey % 5 > 0 THEN c_custkey || ' pafta' END, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey + 1) || ' ada' END, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey + 2) || ' parsel' END, CASE WHEN c_custkey % 13 > 0 THEN (c_custkey + 3) || ' bağımsız bölüm' END) AS land FROM customer)
        SELECT k AS c_custkey, concat_ws(' — ', nullif(place, ''), nullif(land, '')) AS line FROM f""",
    "group_members": """SELECT s_suppkey, nation, count(*) OVER (PARTITION BY nation) AS count FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_nationkey END AS nation FROM supplier)""",
    "union_lists": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN c_acctbal < 0 THEN 'debt' ELSE 'nation' END AS list FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_nationkey = 3""",
    "curation_fingerprint": "WITH " + _digest("""SELECT sha256(concat_ws(chr(31), 'entity', n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR)) AS h FROM nation UNION ALL SELECT sha256(concat_ws(chr(31), 'alias', r_name, r_regionkey::VARCHAR)) FROM region
        UNION ALL SELECT sha256(concat_ws(chr(31), 'operation', c_custkey::VARCHAR, c_name)) FROM customer""") + " SELECT fingerprint FROM x3",
    "stage_fingerprint": " UNION ALL ".join([_stage("identity", "g1", _CUSTOMER), _stage("identity", "g2", _CUSTOMER), _stage("claims", "g1", _SUPPLIER)]),
    "collect_evidence": """WITH e AS (SELECT l_suppkey, 'p' || l_partkey AS id FROM lineitem UNION SELECT l_suppkey, 'o' || (l_orderkey % 10) FROM lineitem)
        SELECT l_suppkey, count(*)::INT AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids_md5 FROM e GROUP BY 1""",
    "stage_cost": "SELECT user_id AS workspace_id, event_type AS stage, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 4) AS cost FROM events GROUP BY 1, 2",
    "recent_documents": f"SELECT doc_id AS document_id, n_chars % 100 AS updated_at FROM documents WHERE doc_id NOT IN ({_DEL}) ORDER BY n_chars % 100 DESC, doc_id LIMIT 6",
    "workspace_states": "SELECT source AS workspace_id, count(*) AS documents, 2 * count(*) AS chunks, max_by(lang, doc_id) AS state FROM documents GROUP BY 1",
    "ingestion_levels": """WITH s AS (SELECT n_regionkey AS r, n_nationkey AS n, count(c_custkey) AS a, count(DISTINCT c_mktsegment) AS b, count(DISTINCT c_mktsegment) FILTER (c_mktsegment > 'BUILDING') AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
        SELECT r AS source_id, count(*) AS n_sections, sum(a)::BIGINT AS n_chunks, sum(b)::BIGINT AS n_entities, sum(c)::BIGINT AS n_nodes, string_agg(n || ',' || a || ',' || b || ',' || c, ';' ORDER BY n) AS sections FROM s GROUP BY 1""",
    "carried_periods": """WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN (1900 + length(text) % 100)::VARCHAR END AS y FROM conversations),
        l AS (SELECT conv_id, turn, list(y) FILTER (y IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM p)
        SELECT conv_id, turn, coalesce(array_to_string(l[-3:], ','), '') AS periods FROM l""",
    "reasoning_cost": """WITH u AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS a, l_quantity::BIGINT AS o, l_partkey AS i FROM lineitem)
        SELECT l_orderkey, l_linenumber, round((i * 10.0::DOUBLE + 5 * 1.0::DOUBLE + CASE WHEN a THEN (o - least(20, o)) * 20.0::DOUBLE + least(20, o) * 40.0::DOUBLE ELSE o * 20.0::DOUBLE END) / 1000000, 8) AS cost FROM u""",
}
