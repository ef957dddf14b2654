"""Queries of knowledge construction: from extractions to entities, relations, events, claims and a generation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators import build as B
from marginalia.operators import knowledge as K
from marginalia.sources import tables as S
from marginalia.sources.session import shared_folder


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(n: int):
    return F.get(F.split("text", " "), F.lit(n))


def retained_mentions(spark, d):
    """The first two words of each document as mentions, every third with a wrong offset, and a dependent on both."""
    docs = _t(spark, d, "documents").where((F.length(_word(0)) > 0) & (F.length(_word(1)) > 0))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    off = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    mention = lambda k, word, start: docs.select(F.concat(F.lit(k), F.col("doc_id").cast("string")).alias("mention_id"), F.col("doc_id").alias("chunk_id"), start.alias("start_offset"), word.alias("quote"))
    mentions = mention("a", _word(0), F.lit(0)).unionByName(mention("b", _word(1), F.length(_word(0)) + 1 + off))
    dependents = docs.select(F.col("doc_id").alias("dependent_id"), F.array(F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.concat(F.lit("b"), F.col("doc_id").cast("string"))).alias("mention_ids"))
    kept, stay, counts = K.retain_exact(mentions, dependents, chunks)
    rows = kept.select(F.lit("mention").alias("kind"), F.col("mention_id").alias("id"), F.lit(None).cast("long").alias("n")).unionByName(stay.select(F.lit("dependent").alias("kind"), F.col("dependent_id").cast("string").alias("id"), F.lit(None).cast("long").alias("n")))
    return rows.unionByName(counts.select(F.concat_ws(" ", "kind", "state").alias("kind"), F.lit(None).cast("string").alias("id"), "n"))


def validated_extractions(spark, d):
    """Orders as assertions with rules on price, status and priority; what breaks one names it."""
    orders = _t(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")))
    rules = {"price": F.col("price") > 1000, "open": F.col("o_orderstatus") != "P", "priority": ~F.startswith("o_orderpriority", F.lit("5"))}
    good, rejects = K.validate_extraction(orders, rules)
    return good.select("o_orderkey", F.lit("").alias("reasons")).unionByName(rejects.select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons")))


def _mapping(spark, d):
    """Customers as mentions of their nation; those in debt are of no entity."""
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("mention_id"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("entity_id"))


def built_relations(spark, d):
    """Orders as relations from their customer to the one whose number follows."""
    relations = _t(spark, d, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("source_mention"), (F.col("o_custkey") + 1).alias("target_mention"))
    good, rejects = K.build_relations(relations, _mapping(spark, d))
    return good.select("relation_id", "source_entity_id", "target_entity_id", F.lit(True).alias("built")).unionByName(rejects.select("relation_id", "source_entity_id", "target_entity_id", F.lit(False).alias("built")))


def _temporals(spark, d):
    """Order dates as ranges, some backwards, without a start, or without a text."""
    k = F.col("o_orderkey")
    at = lambda months: F.date_format(F.add_months("o_orderdate", months), "yyyy-MM-dd")
    return _t(spark, d, "orders").select(
        k.alias("temporal_id"), F.when(k % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("original_text"), F.when(k % 5 > 0, at(0)).alias("normalized_start"),
        F.when(k % 3 == 0, at(-2)).when(k % 3 == 1, at(2)).alias("normalized_end"), F.when(k % 2 == 0, "unknown").otherwise("day").alias("precision"),
    )


def built_temporals(spark, d):
    good, rejects = K.build_temporals(_temporals(spark, d))
    return good.select("temporal_id", F.lit("").alias("reasons")).unionByName(rejects.select("temporal_id", F.concat_ws(",", "reasons").alias("reasons")))


def built_events(spark, d):
    """Orders as events with the customer and two others taking part, at their own time and that of the next order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    person = lambda n, role: F.struct((c + n).alias("mention_id"), F.lit(role).alias("role"))
    events = _t(spark, d, "orders").select(k.alias("event_id"), F.array(person(0, "buyer"), person(1, "witness"), person(1, "witness"), person(2, "buyer")).alias("participants"), F.array(k, k, k + 1).alias("temporal_ids"))
    people, times = K.build_events(events, _mapping(spark, d), K.build_temporals(_temporals(spark, d))[0])
    return people.select("event_id", "entity_id", "role").unionByName(times.select("event_id", F.col("temporal_id").cast("string").alias("entity_id"), F.lit("time").alias("role")))


def built_claims(spark, d):
    claims = _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("subject_mention"), F.lit("ordered").alias("predicate"), F.col("o_orderpriority").alias("value"))
    return K.build_claims(claims, _mapping(spark, d)).select("claim_id", "subject_id", "value")


def split_entities(spark, d):
    """Nations split by segment where every customer is assigned once: of three nations one is left out, of four one is given twice."""
    c = _t(spark, d, "customer")
    entities = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("entity_id"), F.lit("place").alias("entity_type"), F.lit("active").alias("status"))
    mentions = c.select(F.col("c_nationkey").cast("string").alias("entity_id"), F.col("c_custkey").alias("mention_id"))
    first = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) == 1
    marked = c.withColumn("first", first)
    times = F.when(F.col("first") & (F.col("c_nationkey") % 3 == 0), 0).when(F.col("first") & (F.col("c_nationkey") % 4 == 0), 2).otherwise(1)
    given = marked.withColumn("times", times).where("times > 0").select(F.col("c_nationkey").cast("string").alias("entity_id"), F.col("c_custkey").alias("mention_id"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("new_entity_id"), F.explode(F.sequence(F.lit(1), "times")).alias("_n")).drop("_n")
    after, moved, checks = K.split_entities(entities, mentions, given)
    rows = after.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("status").alias("value"))
    n = moved.groupBy("entity_id").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("mentions").alias("kind"), F.col("entity_id").alias("id"), "value")
    return rows.unionByName(n).unionByName(checks.select(F.lit("check").alias("kind"), F.col("entity_id").alias("id"), F.col("complete").cast("string").alias("value")))


def entity_catalogs(spark, d):
    """Parts of one generation with their brand and type as aliases, where these are active."""
    part = _t(spark, d, "part")
    entities = part.select(F.col("p_partkey").alias("entity_id"), "p_name", (F.col("p_size") % 3).cast("string").alias("generation_id"))
    alias = lambda value, active: part.select(F.col("p_partkey").alias("entity_id"), F.col(value).alias("value"), active.alias("active"))
    aliases = alias("p_brand", F.col("p_size") > 25).unionByName(alias("p_type", F.col("p_size") < 30)).unionByName(alias("p_type", F.lit(True)).where("p_size = 1"))
    return K.entity_catalog(entities, aliases, "1").select("entity_id", "p_name", F.concat_ws(",", "aliases").alias("aliases"))


def ranked_names(spark, d):
    """Names of two capitalised words in sentences about parts, some of them with terms or numbers, sought by their words in
    either order; those of small parts are known from metadata."""
    part = _t(spark, d, "part")
    word = lambda n: F.initcap(F.get(F.split("p_name", " "), F.lit(n)))
    name, k = F.concat_ws(" ", word(0), word(1)), F.col("p_size")
    content = F.concat(F.lit("seen: "), name, F.when(k % 3 == 0, " by tapu").otherwise(" by day"), F.when(k % 4 > 0, " 12 34 5678").otherwise(""))
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), (k % 4).alias("document_id"), content.alias("content"))
    words = part.select(word(0).alias("a"), word(1).alias("b")).distinct()
    mentions = words.select("b").distinct().select(F.lower("b").alias("text")).unionByName(words.select(F.concat_ws(" ", F.lit("Dr."), "b", F.upper("a")).alias("text"))).select(F.col("text").alias("mention_id"), "text")
    found = K.rank_names(mentions, chunks, part.where("p_size < 5").select(name.alias("name")))
    return found.withColumn("basis", F.concat_ws(",", "basis"))


def cutover_reports(spark, d):
    """Users as runs that are accepted where they had purchases, few errors and a mean value of at least 24."""
    e = _t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg(F.when(F.col("event_type") != "login", F.col("value"))).alias("mean"))
    gates = {"no_purchase": F.col("purchases") > 0, "errors": F.col("errors") <= 60, "low_mean": F.col("mean") >= 24}
    return K.cutover_report(e, gates).select("user_id", "accepted", F.concat_ws(",", "reasons").alias("reasons"))


def _extract(text: str) -> str:
    """The first two words as mentions of a relation, a claim and an event; a text of one word is broken, an empty one raises."""
    import json

    words = text.split(" ")
    if len(words) < 2:
        return "{" if text else words[1]
    first, second = words[0], words[1]
    mention = lambda i, w, at: {"mention_id": i, "text": w, "entity_type": "word", "start_offset": at}
    return json.dumps({
        "mentions": [mention("a", first, 0), mention("b", second, len(first) + 1)],
        "relations": [{"relation_id": "r", "source_mention": "a", "target_mention": "b", "relation_type": "before"}],
        "events": [{"event_id": "e", "event_type": "said", "participants": [{"mention_id": "a", "role": "first"}], "temporal_ids": ["t"]}],
        "temporals": [{"temporal_id": "t", "original_text": "now", "normalized_start": "2024", "normalized_end": None, "precision": "year"}],
        "claims": [{"claim_id": "c", "subject_mention": "b", "predicate": "follows", "value": first}],
    })


def _chunks(spark, d):
    """Texts without blanks other than single spaces; every ninth of one word."""
    text = F.trim(F.regexp_replace("text", r"[^A-Za-z]+", " "))
    return _t(spark, d, "documents").select(F.col("source").alias("workspace_id"), F.col("lang").alias("version_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 9 == 0, "word").otherwise(text).alias("content"))


def extracted_chunks(spark, d):
    """What a user's function makes of each chunk; where it raises there is no bundle."""
    chunks = _chunks(spark, d).withColumn("content", F.when(F.col("chunk_id").cast("long") % 4 == 0, "").otherwise(F.col("content")))
    found = B.extract_chunks(chunks, _extract)
    return found.select("chunk_id", F.col("bundle").isNull().alias("failed"), F.get_json_object("bundle", "$.mentions[1].text").alias("second"))


def constructed_generation(spark, d):
    """All stages of a generation over the documents, each written; a second call reads them."""
    folder = shared_folder(spark, "generations")
    B.construct(_chunks(spark, d), _extract, folder, "g1")

    def never(text: str) -> str:
        raise AssertionError("read, not run")

    tables = B.construct(_chunks(spark, d), never, folder, "g1")
    rows = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def mentioned_words(spark, d):
    """The entities of a generation: words that documents begin with, in lower case, and how often they do."""
    tables = B.construct(_chunks(spark, d), _extract, shared_folder(spark, "generations"), "g1")
    return tables["entities"].select(F.lower("display_name").alias("word"), "entity_type", "n_mentions")


def capability_node(spark, d):
    """A function that a user registers by name and runs with parameters."""
    B.CAPABILITIES.pop("cheaper_than", None)
    B.capability("cheaper_than")(lambda rows, price, column="o_totalprice": rows.where(F.col(column) < price))
    return B.apply_capability(_t(spark, d, "orders"), "cheaper_than", price=50_000.0).select("o_orderkey", "o_totalprice")


def stage_registry(spark, d):
    """Stages by name, run in turn, each on what the one before made."""
    stages = B.Stages()
    stages.add("open", lambda rows: rows.where("o_orderstatus = 'O'"))
    stages.add("by_customer", lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")))
    return stages.run(_t(spark, d, "orders"), ["open", "by_customer"])


QUERIES = {
    f.__name__: f
    for f in (
        retained_mentions, validated_extractions, built_relations, built_temporals, built_events, built_claims, split_entities, entity_catalogs, ranked_names,
        cutover_reports, extracted_chunks, constructed_generation, mentioned_words, capability_node, stage_registry,
    )
}

_MAP = "m AS (SELECT c_custkey AS i, 'n' || c_nationkey AS e FROM customer WHERE c_acctbal >= 0)"
_TIME = """t AS (SELECT o_orderkey AS k, concat_ws(',', CASE WHEN s > e THEN 'backwards' WHEN s IS NULL AND e IS NOT NULL THEN 'backwards' END, CASE WHEN k % 2 = 1 AND s IS NULL THEN 'no_start' END, CASE WHEN k % 13 = 0 THEN 'no_text' END) AS reasons
  FROM (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate - INTERVAL 2 MONTH, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') END AS e FROM orders))"""
_CH = """c AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN 'word' ELSE trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) END AS t FROM documents), w AS (SELECT doc_id, lang, t, string_split(t, ' ') AS w FROM c),
g AS (SELECT doc_id, lang, w[1] AS a, w[2] AS b FROM w WHERE len(w) > 1), mn AS (SELECT doc_id, lang, lower(a) AS x FROM g UNION ALL SELECT doc_id, lang, lower(b) FROM g)"""

ORACLE = {
    "retained_mentions": """WITH w AS (SELECT doc_id, text, string_split(text, ' ')[1] AS a, string_split(text, ' ')[2] AS b FROM documents), v AS (SELECT *, substr(text, length(a) + 2 + (doc_id % 3 = 0)::INT, length(b)) = b AS ok FROM w WHERE length(a) > 0 AND length(b) > 0)
        SELECT 'mention' AS kind, 'a' || doc_id AS id, NULL::BIGINT AS n FROM v UNION ALL SELECT 'mention', 'b' || doc_id, NULL FROM v WHERE ok UNION ALL SELECT 'dependent', doc_id::VARCHAR, NULL FROM v WHERE ok
        UNION ALL SELECT 'mention given', NULL, 2 * count(*) FROM v UNION ALL SELECT 'mention kept', NULL, count(*) + count(*) FILTER (ok) FROM v UNION ALL SELECT 'dependent given', NULL, count(*) FROM v UNION ALL SELECT 'dependent kept', NULL, count(*) FILTER (ok) FROM v""",
    "validated_extractions": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 10 = 0 OR o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'priority' END) AS reasons FROM orders""",
    "built_relations": f"""WITH {_MAP} SELECT o_orderkey AS relation_id, a.e AS source_entity_id, b.e AS target_entity_id, a.e IS NOT NULL AND b.e IS NOT NULL AS built FROM orders LEFT JOIN m a ON a.i = o_custkey LEFT JOIN m b ON b.i = o_custkey + 1""",
    "built_temporals": f"WITH {_TIME} SELECT k AS temporal_id, reasons FROM t",
    "built_events": f"""WITH {_MAP}, {_TIME}, p AS (SELECT o_orderkey AS k, unnest([o_custkey, o_custkey + 1, o_custkey + 2]) AS i, unnest(['buyer', 'witness', 'buyer']) AS role FROM orders)
        SELECT DISTINCT k AS event_id, e AS entity_id, role FROM p JOIN m USING (i) UNION ALL SELECT o_orderkey, k::VARCHAR, 'time' FROM orders JOIN t ON k IN (o_orderkey, o_orderkey + 1) WHERE reasons = ''""",
    "built_claims": f"WITH {_MAP} SELECT o_orderkey AS claim_id, e AS subject_id, o_orderpriority AS value FROM orders JOIN m ON i = o_custkey",
    "split_entities": """WITH x AS (SELECT n_nationkey AS k, count(c_custkey) > 0 AS asked, n_nationkey % 3 > 0 AND n_nationkey % 4 > 0 AS whole FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
        y AS (SELECT k, asked AND whole AS done FROM x)
        SELECT 'entity' AS kind, k::VARCHAR AS id, CASE WHEN done THEN 'split' ELSE 'active' END AS value FROM y UNION ALL SELECT DISTINCT 'entity', c_nationkey || '-' || c_mktsegment, 'active' FROM customer JOIN y ON k = c_nationkey WHERE done
        UNION ALL SELECT 'mentions', CASE WHEN done THEN c_nationkey || '-' || c_mktsegment ELSE c_nationkey::VARCHAR END, count(*)::VARCHAR FROM customer JOIN y ON k = c_nationkey GROUP BY 2
        UNION ALL SELECT 'check', k::VARCHAR, whole::VARCHAR FROM x WHERE asked""",
    "entity_catalogs": """SELECT p_partkey AS entity_id, p_name, concat_ws(',', CASE WHEN p_size > 25 THEN least(p_brand, CASE WHEN p_size < 30 THEN p_type ELSE p_brand END) END,
        CASE WHEN p_size > 25 AND p_size < 30 THEN greatest(p_brand, p_type) WHEN p_size <= 25 THEN p_type END) AS aliases FROM part WHERE p_size % 3 = 1""",
    "ranked_names": r"""WITH a AS (SELECT p_size AS k, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS w FROM part),
        n AS (SELECT w[1] AS a, w[2] AS b, w[1] || ' ' || w[2] AS name, count(DISTINCT k % 4) AS documents, count(*) AS passages, bool_or(k % 3 = 0) AS described, bool_and(k % 4 > 0) AS numbers, bool_or(k < 5) AS known FROM a GROUP BY ALL),
        p AS (SELECT *, least(99, 73 + least(12, 4 * documents) + least(8, 2 * passages) + 6 * described::INT + 8 * known::INT - 18 * numbers::INT)::INT AS points FROM n),
        m AS (SELECT DISTINCT lower(b) AS mention_id, [lower(b)] AS wanted FROM n UNION SELECT DISTINCT 'Dr. ' || b || ' ' || upper(a), [lower(a), lower(b)] FROM n),
        j AS (SELECT * FROM m JOIN p ON list_has_all([lower(a), lower(b)], wanted)),
        r AS (SELECT *, row_number() OVER w AS rank, lead(points) OVER w AS next FROM j WINDOW w AS (PARTITION BY mention_id ORDER BY points DESC, documents DESC, name))
        SELECT mention_id, name, points / 100 AS score, documents, passages, concat_ws(',', 'full_name_token', 'documents:' || documents, CASE WHEN described THEN 'descriptive_context' END, CASE WHEN known THEN 'metadata' END) AS basis, rank,
        rank = 1 AND points >= 72 AND (next IS NULL OR points - next >= 8) AS resolved FROM r WHERE rank <= 12""",
    "cutover_reports": """WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e, avg(value) FILTER (event_type <> 'login') AS m FROM events GROUP BY 1),
        r AS (SELECT user_id, concat_ws(',', CASE WHEN p = 0 THEN 'no_purchase' END, CASE WHEN e > 60 THEN 'errors' END, CASE WHEN NOT coalesce(m >= 24, false) THEN 'low_mean' END) AS reasons FROM e) SELECT user_id, reasons = '' AS accepted, reasons FROM r""",
    "extracted_chunks": f"""WITH {_CH} SELECT doc_id::VARCHAR AS chunk_id, doc_id % 4 = 0 OR t = '' AS failed, CASE WHEN doc_id % 4 <> 0 AND len(w) > 1 THEN w[2] END AS second FROM w""",
    "constructed_generation": f"""WITH {_CH}, n AS (SELECT count(*) AS c, (SELECT count(*) FROM g) AS g, (SELECT count(DISTINCT x) FROM mn) AS x FROM c)
        SELECT unnest(['extraction', 'mentions', 'identity', 'entities', 'relations', 'temporals', 'participants', 'event_times', 'claims', 'rejects']) AS stage, unnest([c, 2 * g, 2 * g, x, g, g, g, g, g, c - g]) AS n FROM n""",
    "mentioned_words": f"WITH {_CH} SELECT x AS word, 'word' AS entity_type, count(*) AS n_mentions FROM mn GROUP BY 1",
    "capability_node": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000",
    "stage_registry": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
}
