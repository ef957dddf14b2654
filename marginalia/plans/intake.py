"""Queries of sources, intake checks and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import corpus as C
from marginalia.operators import evidence as E
from marginalia.operators import knowledge as K
from marginalia.operators import logs as L
from marginalia.operators import retrieval as Q
from marginalia.sources import tables as S


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def active_corpus(spark, d):
    """Documents as chunks of their active version, without those of low quality."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("workspace_id"), F.col("doc_id").alias("document_id"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version_id"))
    gone = _t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit("2026-01-01").alias("deleted_at")).distinct()
    documents = docs.join(gone, "document_id", "left").withColumn("active_version_id", F.lit("v1"))
    return S.active_corpus(docs, documents).select("workspace_id", "document_id")


def scan_population(spark, d):
    """The population of one brand in discovery mode, cut at 20 rows, and whether it was read in full."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("resource"))
    rows, complete = S.scan_population(part, "Brand#11", "discovery", 20)
    return rows.select("record_id", "resource").join(complete.select("resource", "expected", "enumerated", "complete"), "resource")


def scan_populations(spark, d):
    """The population of each brand, read in full."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("resource"))
    rows, complete = S.scan_populations(part)
    complete = complete.withColumnRenamed("resource", "of")
    return rows.join(complete, F.col("resource").eqNullSafe(F.col("of"))).select("record_id", "resource", "expected", "enumerated", "complete")


def classify_files(spark, d):
    """Pages as files of four kinds."""
    k = F.col("page_id") % 4
    name = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(k == 0, ".pdf").when(k == 1, ".TXT").when(k == 2, ".exe").otherwise(".md"))
    files = _t(spark, d, "pages").select(name.alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return S.classify_files(files)


def graph_artifacts(spark, d):
    found = S.graph_artifacts(_t(spark, d, "supplier"), "entities", ["id", "s_suppkey"], ["text", "s_name"])
    return found.select("id", "text", F.col("attributes")["s_nationkey"].alias("nation"), F.size("attributes").alias("n"))


def parse_extractions(spark, d):
    """Orders as bundles of one mention and one claim; urgent ones are broken."""
    mention = F.struct(F.lit("m").alias("mention_id"), F.col("o_orderstatus").alias("text"), F.lit("status").alias("entity_type"), F.lit(0).alias("start_offset"))
    claim = F.struct(F.lit("c").alias("claim_id"), F.lit("m").alias("subject_mention"), F.lit("is").alias("predicate"), F.col("o_orderpriority").alias("value"))
    text = F.to_json(F.struct(F.array(mention).alias("mentions"), F.array(claim).alias("claims")))
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.substring(text, 1, 30)).otherwise(text).alias("bundle"))
    parts, rejects = S.parse_extractions(rows)
    good = parts["mentions"].join(parts["claims"], "chunk_id").select("chunk_id", "text", "value")
    return good.unionByName(rejects.select("chunk_id", F.lit("rejected").alias("text")), allowMissingColumns=True)


def orphan_refs(spark, d):
    """Parts that lines name and the small-part catalogue lacks."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_set("l_partkey").alias("refs"))
    return E.orphan_refs(lines, _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id")))


def nodes_per_generation(spark, d):
    return L.nodes_per_generation(_t(spark, d, "customer").select(F.col("c_nationkey").alias("generation_id")))


def plan_reindex(spark, d):
    """Users as workspaces: built at their first purchase, changed at their last click."""
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    states = _t(spark, d, "events").groupBy(F.col("user_id").alias("workspace_id")).agg(F.min(at("purchase")).alias("built_at"), F.max(at("click")).alias("corpus_changed_at"), F.max(at("purchase")).alias("_l"))
    marked = states.withColumns({"config_hash": F.when(F.col("workspace_id") % 10 == 0, "old").otherwise("new"), "state": F.when(F.col("workspace_id") % 7 == 0, "failed").when(F.col("workspace_id") % 7 == 1, "building").otherwise("ready")})
    return C.plan_reindex(marked, F.lit("new"))


def advance_claims(spark, d):
    """Orders as claims: lines are the evidence, open orders have no reviewer."""
    claims = _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "P", "supported").otherwise("extracted").alias("stage"))
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count(F.lit(1)).alias("evidence_count"))
    wanted = _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "P", "verified").otherwise("supported").alias("to_stage"), F.when(F.col("o_custkey") % 2 == 0, "r").alias("reviewer"))
    return K.advance_claims(claims, wanted.join(n, "claim_id", "left"))


def artifact_lineage(spark, d):
    """Brands as artifacts: their parts are units, and the suppliers of these their documents."""
    part, line = _t(spark, d, "part"), _t(spark, d, "lineitem")
    artifacts = part.groupBy(F.col("p_brand").alias("artifact_id")).agg(F.collect_list("p_partkey").alias("unit_ids"))
    units = line.groupBy(F.col("l_partkey").alias("unit_id")).agg(F.collect_set("l_suppkey").alias("document_ids"))
    documents = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_nationkey").alias("logical_id"))
    found = Q.artifact_lineage(artifacts, units, documents)
    return found.select("artifact_id", F.concat_ws(",", F.transform("logical_ids", lambda x: x.cast("string"))).alias("logical_ids"))


QUERIES = {f.__name__: f for f in (active_corpus, scan_population, scan_populations, classify_files, graph_artifacts, parse_extractions, orphan_refs, nodes_per_generation, plan_reindex, advance_claims, artifact_lineage)}

ORACLE = {
    "active_corpus": "SELECT source AS workspace_id, doc_id AS document_id FROM documents WHERE doc_id % 3 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "scan_populations": """SELECT p_partkey AS record_id, p_brand AS resource, count(*) OVER (PARTITION BY p_brand) AS expected,
count(*) OVER (PARTITION BY p_brand) AS enumerated, true AS complete FROM part""",
    "scan_population": """SELECT p_partkey AS record_id, p_brand AS resource, n AS expected, least(n, 20) AS enumerated, n <= 20 AS complete
        FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_brand = 'Brand#11') WHERE r <= 20""",
    "classify_files": """SELECT '/in/' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.exe' ELSE '.md' END AS path, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'exe' ELSE 'md' END AS extension,
        page_id % 2 = 1 AS accepted, CASE page_id % 4 WHEN 0 THEN 'content' WHEN 2 THEN 'extension' END AS reason FROM pages""",
    "graph_artifacts": "SELECT s_suppkey::VARCHAR AS id, s_name AS text, s_nationkey::VARCHAR AS nation, 2 AS n FROM supplier",
    "parse_extractions": "SELECT o_orderkey AS chunk_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rejected' ELSE o_orderstatus END AS text, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS value FROM orders",
    "orphan_refs": "SELECT DISTINCT l_orderkey AS owner, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)",
    "nodes_per_generation": "SELECT c_nationkey AS generation_id, count(*) AS nodes FROM customer GROUP BY 1",
    "plan_reindex": """WITH s AS (SELECT user_id AS w, min(ts) FILTER (event_type = 'purchase') AS b, max(ts) FILTER (event_type = 'click') AS c FROM events GROUP BY 1),
        r AS (SELECT w, CASE WHEN b IS NULL THEN 'never_built' WHEN w % 10 = 0 THEN 'config_changed' WHEN w % 7 = 0 THEN 'failed' WHEN w % 7 = 1 THEN 'building' WHEN c > b THEN 'corpus_changed' ELSE 'current' END AS reason FROM s)
        SELECT w AS workspace_id, CASE reason WHEN 'current' THEN 'none' ELSE 'full' END AS action, reason FROM r""",
    "advance_claims": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus = 'P' AS p, coalesce(CASE WHEN o_orderstatus = 'P' THEN o_custkey % 2 = 0 ELSE n > 0 END, false) AS ok FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
        SELECT o_orderkey AS claim_id, CASE WHEN p THEN CASE WHEN ok THEN 'verified' ELSE 'supported' END WHEN ok THEN 'supported' ELSE 'extracted' END AS stage, NOT ok AS violation FROM o""",
    "artifact_lineage": """SELECT p_brand AS artifact_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS logical_ids FROM
        (SELECT DISTINCT p_brand, s_nationkey AS k FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1""",
}
