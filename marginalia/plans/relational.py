"""Queries of the relational operators over the orders, customers and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import relational as R


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_eq(spark, d):
    return R.where_cmp(_t(spark, d, "customer"), "c_mktsegment", "eq", "BUILDING").select("c_custkey", "c_mktsegment")


def filter_not_eq(spark, d):
    return R.where_cmp(_t(spark, d, "customer"), "c_mktsegment", "not_eq", "BUILDING").select("c_custkey", "c_mktsegment")


def filter_range(spark, d):
    part = R.where_cmp(R.where_cmp(_t(spark, d, "part"), "p_size", "gte", 10), "p_size", "lt", 20)
    return part.select("p_partkey", "p_size")


def filter_in(spark, d):
    return R.where_cmp(_t(spark, d, "part"), "p_size", "in", [1, 5, 9]).select("p_partkey", "p_size")


def filter_contains(spark, d):
    return R.where_cmp(_t(spark, d, "part"), "p_name", "contains", "E").select("p_partkey", "p_name")


def filter_starts_with(spark, d):
    return R.where_cmp(_t(spark, d, "part"), "p_type", "starts_with", "s").select("p_partkey", "p_type")


def filter_exists(spark, d):
    return R.where_cmp(_t(spark, d, "documents"), "lang", "exists").select("doc_id", "lang")


def project_rename(spark, d):
    return R.project(_t(spark, d, "nation"), {"id": "n_nationkey", "name": "n_name", "parent": "n_regionkey"})


def temporal_filter(spark, d):
    orders = _t(spark, d, "orders").withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.temporal_filter(orders, "start", None, [("1994-01-01", "1996-12-31"), ("1995-06-01", "1999")]).select("o_orderkey", "start")


def temporal_relative(spark, d):
    orders = _t(spark, d, "orders")
    return R.temporal_relative(orders, "o_orderdate", orders.where("o_orderpriority = '1-URGENT'"), "o_orderdate", "after", ["o_custkey"]).select("o_orderkey", "o_custkey")


def temporal_window(spark, d):
    """Order dates as the start of ranges of which some have an end."""
    orders = _t(spark, d, "orders").withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd"))
    ranges = orders.withColumn("end", F.when(F.col("o_orderkey") % 3 > 0, F.date_format(F.date_add("o_orderdate", 200), "yyyy-MM-dd")))
    return R.temporal_filter(ranges, "start", "end", [("1994-01-01", "1996-12-31")]).select("o_orderkey", "start", "end")


def temporal_before(spark, d):
    """Orders before the last urgent one, of any customer."""
    orders = _t(spark, d, "orders")
    return R.temporal_relative(orders, "o_orderdate", orders.where("o_orderpriority = '1-URGENT' and o_orderkey % 11 = 0"), "o_orderdate", "before").select("o_orderkey")


def filter_bounds(spark, d):
    """Above one bound and up to another; nulls are in no range."""
    part = _t(spark, d, "part").withColumn("size", F.when(F.col("p_partkey") % 10 > 0, F.col("p_size")))
    return R.where_cmp(R.where_cmp(part, "size", "gt", 10), "size", "lte", 30).select("p_partkey", "size")


def sort_many(spark, d):
    """Nulls first in one key, last in another."""
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 100 > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey")).alias("nation"))
    return R.limit_records(R.sort_records(c, [("segment", "asc", "first"), ("nation", "desc", "last")], "c_custkey"), 200, 5)


def required_scope(spark, d):
    return R.require_scope(R.in_scope(_t(spark, d, "documents"), {"lang": "en"}), {"lang": "en"}).select("doc_id", "lang")


def join_inner(spark, d):
    joined = R.join_records(_t(spark, d, "customer"), _t(spark, d, "nation"), [("c_nationkey", "eq", "n_nationkey")])
    return joined.select("c_custkey", "right_n_name")


def join_theta(spark, d):
    supplier = _t(spark, d, "supplier")
    joined = R.join_records(supplier, supplier, [("s_nationkey", "eq", "s_nationkey"), ("s_suppkey", "not_eq", "s_suppkey")])
    return joined.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("others"))


def join_left(spark, d):
    orders = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = R.join_records(_t(spark, d, "customer"), orders, [("c_custkey", "eq", "o_custkey")], "left")
    return joined.select("c_custkey", F.col("right_n").alias("n_orders"))


def join_semi(spark, d):
    return R.join_records(_t(spark, d, "customer"), _t(spark, d, "orders"), [("c_custkey", "eq", "o_custkey")], "semi").select("c_custkey")


def join_anti(spark, d):
    return R.join_records(_t(spark, d, "customer"), _t(spark, d, "orders"), [("c_custkey", "eq", "o_custkey")], "anti").select("c_custkey")


def group_count(spark, d):
    return R.group_records(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def count_distinct(spark, d):
    return R.count_distinct(_t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag"])


def agg_min_max_sum_avg(spark, d):
    calls = {"low": ("minimum", "l_quantity"), "high": ("maximum", "l_quantity"), "total": ("sum", "l_quantity"), "mean": ("average", "l_quantity")}
    return R.aggregate(_t(spark, d, "lineitem"), calls, ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


def exists_any(spark, d):
    return R.exists_records(R.where_cmp(_t(spark, d, "lineitem"), "l_discount", "gt", 0.09))


def sort_offset_limit(spark, d):
    ordered = R.sort_records(_t(spark, d, "orders"), [("o_totalprice", "desc", "last")], "o_orderkey")
    return R.limit_records(ordered.select("o_orderkey", "o_totalprice"), 20, 10)


def rank_top_n(spark, d):
    return R.rank_records(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey", top=3, by=["o_custkey"])


def rank_all(spark, d):
    return R.rank_records(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def rank_payload(spark, d):
    """A whole ranking whose records have other columns than those of the order."""
    lines = _t(spark, d, "lineitem").select(F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("line"), "l_extendedprice", "l_returnflag", "l_shipdate")
    return R.rank_records(lines, "l_extendedprice", "line").select("line", "rank", "l_returnflag")


def latest_per_key(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return R.latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def first_seen(spark, d):
    return R.first_seen(_t(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source"), ["digest"], ["doc_id"]).select("doc_id", "source")


def distinct_fields(spark, d):
    return R.distinct_records(_t(spark, d, "documents"), ["lang", "source"])


def _sides(spark, d):
    customers = R.project(_t(spark, d, "customer"), {"id": "c_custkey"})
    return customers, R.project(_t(spark, d, "orders"), {"id": "o_custkey"})


def compare_overlap(spark, d):
    return R.compare_sets(*_sides(spark, d), "id", "overlap")


def compare_difference(spark, d):
    return R.compare_sets(*_sides(spark, d), "id", "difference")


def compare_values(spark, d):
    return R.compare_sets(*_sides(spark, d), "id", "values")


def compare_populations(spark, d):
    return R.compare_sets(*_sides(spark, d), "id", "populations")


def merge_by_authority(spark, d):
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") % 3 * 10 + 10).alias("authority"))
    current = R.latest_per_key(items.where("l_linenumber <= 3"), ["l_partkey"], ["authority", "l_orderkey", "l_linenumber"])
    incoming = R.latest_per_key(items.where("l_linenumber > 3"), ["l_partkey"], ["authority", "l_orderkey", "l_linenumber"])
    return R.merge_by_authority(current, incoming, ["l_partkey"], "authority").select("l_partkey", "authority", "l_orderkey")


def preferred_claims(spark, d):
    supplier = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey"))  # some claim nothing
    claims = _t(spark, d, "lineitem").select("l_partkey", supplier.alias("l_suppkey"), F.col("l_quantity").cast("int").alias("authority"))
    return R.preferred_claims(claims, ["l_partkey"], "l_suppkey", "authority")


def detect_conflicts(spark, d):
    return R.detect_conflicts(_t(spark, d, "part"), ["p_name"], "p_brand").select("p_name", "n_values", F.concat_ws(",", "values").alias("brands"))


def tombstone_filter(spark, d):
    return R.tombstone(_t(spark, d, "documents"), _t(spark, d, "labels").where("quality = 0"), "doc_id").select("doc_id", "source")


def scope_filter(spark, d):
    return R.in_scope(_t(spark, d, "documents"), {"source": "src3", "lang": "en"}).select("doc_id", "source", "lang")


def retention_cut(spark, d):
    events = _t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("at").alias("now"))
    joined = events.join(F.broadcast(last))
    return R.retention(joined, "at", 7, F.col("now")).select("event_id")


QUERIES = {
    f.__name__: f
    for f in (
        filter_eq, filter_not_eq, filter_range, filter_in, filter_contains, filter_starts_with, filter_exists, project_rename, temporal_filter, temporal_window, temporal_before, filter_bounds, sort_many, required_scope,
        temporal_relative, join_inner, join_theta, join_left, join_semi, join_anti, group_count, count_distinct, agg_min_max_sum_avg, exists_any,
        sort_offset_limit, rank_top_n, rank_all, rank_payload, latest_per_key, first_seen, distinct_fields, compare_overlap, compare_difference, compare_values,
        compare_populations, merge_by_authority, preferred_claims, detect_conflicts, tombstone_filter, scope_filter, retention_cut,
    )
}

ORACLE = {
    "filter_eq": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "temporal_window": """SELECT o_orderkey, start, "end" FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate + INTERVAL 200 DAY, '%Y-%m-%d') END AS "end" FROM orders)
        WHERE start >= '1994-01-01' AND coalesce("end", start) <= '1996-12-31'""",
    "temporal_before": "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 11 = 0)",
    "filter_bounds": "SELECT p_partkey, p_size AS size FROM part WHERE p_partkey % 10 > 0 AND p_size > 10 AND p_size <= 30",
    "sort_many": """SELECT c_custkey, CASE WHEN c_custkey % 100 > 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS nation FROM customer ORDER BY segment ASC NULLS FIRST, nation DESC NULLS LAST, c_custkey LIMIT 200 OFFSET 5""",
    "required_scope": "SELECT doc_id, lang FROM documents WHERE lang = 'en'",
    "filter_not_eq": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'",
    "filter_range": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20",
    "filter_in": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)",
    "filter_contains": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e')",
    "filter_starts_with": "SELECT p_partkey, p_type FROM part WHERE starts_with(lower(p_type), 's')",
    "filter_exists": "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL",
    "project_rename": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent FROM nation",
    "temporal_filter": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders
        WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1994-01-01' AND '1996-12-31' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-06-01' AND '1999'""",
    "temporal_relative": """SELECT o_orderkey, o.o_custkey FROM orders o JOIN
        (SELECT o_custkey, min(o_orderdate) AS b FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a ON a.o_custkey = o.o_custkey WHERE o_orderdate > b""",
    "join_inner": "SELECT c_custkey, n_name AS right_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_theta": "SELECT a.s_suppkey, count(*) AS others FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1",
    "join_left": "SELECT c_custkey, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "join_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "group_count": "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS count_distinct FROM lineitem GROUP BY 1",
    "agg_min_max_sum_avg": "SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "exists_any": "SELECT count(*) > 0 AS exists FROM lineitem WHERE l_discount > 0.09::DOUBLE",
    "sort_offset_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10",
    "rank_top_n": """SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
    "rank_all": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders",
    "rank_payload": """WITH l AS (SELECT concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line, * FROM lineitem)
        SELECT line, row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, line) AS rank, l_returnflag FROM l""",
    "latest_per_key": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "first_seen": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "distinct_fields": "SELECT DISTINCT lang, source FROM documents",
    "compare_overlap": "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders",
    "compare_difference": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders",
    "compare_values": "SELECT count(*) = 0 AS equal FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL",
    "compare_populations": "SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS left_count, (SELECT count(DISTINCT o_custkey) FROM orders) AS right_count",
    "merge_by_authority": """WITH i AS (SELECT *, l_linenumber % 3 * 10 + 10 AS authority, l_linenumber > 3 AS late FROM lineitem),
        b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, late ORDER BY authority DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM i)
        SELECT l_partkey, authority, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY authority DESC, late DESC) AS s FROM b WHERE r = 1) WHERE s = 1""",
    "preferred_claims": """SELECT l_partkey, min(l_suppkey) AS l_suppkey, min(authority) AS authority FROM
        (SELECT l_partkey, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS l_suppkey, l_quantity::INT AS authority, max(l_quantity::INT) OVER (PARTITION BY l_partkey) AS top FROM lineitem) WHERE authority = top GROUP BY 1 HAVING count(DISTINCT coalesce(l_suppkey, -1)) = 1""",
    "detect_conflicts": "SELECT p_name, count(DISTINCT p_brand) AS n_values, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "tombstone_filter": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "scope_filter": "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'",
    "retention_cut": "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
}
