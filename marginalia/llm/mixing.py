"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights by order of the source, the share of all words, and the most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
#: Log odds are summed in so many steps a unit, so that no task has to order a whole source.
STEPS = 256
#: The most sources whose rows (six numbers and a name) are broadcast.
BROADCAST_SOURCES = 50_000


def uniform(column: Column, seed: str = "") -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a digest of the seed and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def text_tag(text_col: str) -> Column:
    """Tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))


def targets(sizes: DataFrame, share: float = SHARE, copies: int = COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words of each source.

    `sizes` has a row (source, source_size) for each source. Sources weigh `weights` in turn by code point, null last.
    They divide `share` of all words by weight; a target ends at `copies` times its source's words and the excess is
    divided among the others. In closed form: with sources ordered by limit over weight, those before the first that
    keeps its plain share are full, and one rate per weight serves the rest. All windows here run over one row a source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    full = F.col("limit")
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("turn"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    return (
        sizes.withColumn("turn", turn)
        .withColumn("weight", F.element_at(given, (F.col("turn") % len(weights) + 1).cast("int")))
        .withColumn("limit", float(copies) * F.col("source_size"))
        .withColumn("words", share * F.sum("source_size").over(W.partitionBy()))
        .withColumn("left", F.col("words") - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.col("rate") * F.col("weight") <= full)
        .withColumn("first_rate", F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.coalesce(F.least(full, F.col("first_rate") * F.col("weight")), full))
        .select("source", "source_size", "target")
    )


def scales(plain: DataFrame, sources: DataFrame) -> DataFrame:
    """(of, scale): what a document's size is multiplied with to give its inclusion probability.

    A source's sample has `left` words: scale solves sum(size * min(1, scale * size)) = left. Documents of over 1 / scale
    words are certain. Only the distinct sizes of a source are ordered, the greatest that can stay uncertain decides.
    """
    sizes = plain.where("size > 0").groupBy("of", "size").agg(F.count(F.lit(1)).cast("double").alias("n")).join(sources, "of")
    upto = W.partitionBy("of").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    words, squares = F.sum(F.col("n") * F.col("size")).over(upto), F.sum(F.col("n") * F.col("size") * F.col("size")).over(upto)
    scale = (F.col("left") - (F.col("source_size") - F.col("words"))) / F.col("squares")
    held = sizes.withColumn("words", words).withColumn("squares", squares).withColumn("scale", scale).where(F.col("scale") * F.col("size") <= 1)
    return held.groupBy("of").agg(F.max_by("scale", "size").alias("scale"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, copies: int = COPIES, weights: tuple[int, ...] = WEIGHTS, steps: int = STEPS, seed: str = "") -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, inclusion, copies, taken, tag (of the text). Each source's rate (target over size) is
    allocated as whole copies of every document first. What is left of the target is a sample of unequal probabilities:
    a document's inclusion probability is proportional to its size, so that the expected words are what is left;
    documents for which it would be 1 are certain. The others are ranked in Pareto order, by random odds u/(1-u) over
    inclusion odds p/(1-p), smallest first. The sample has a fixed size in words: documents are taken while the words
    before one and half its own are within what is left, so a source ends within half a document of its target. The
    order is found without ordering a source in one task: words are summed in steps of the logarithm of the odds, and
    documents are ordered within a source's step only.

    Null text has size 0; a null source is a source of its own, after all others. Documents of size 0 and sources of
    size 0 take 0. Equal odds are ordered by the random number, then by doc_id (null last), then by size; rows that
    repeat a document are documents of their own. An empty table gives no rows. Other columns are ignored, whatever their
    names. Another `seed` draws another sample.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_tag(text_col).alias("tag"))
    plain = plain.withColumn("u", uniform(F.col("doc_id"), seed))
    plain = cut(plain.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))  # counts the words once; ids and numbers only
    sources = targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")), share, copies, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (
        sources.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("of", "source_size", "target", "whole", "left")
    )
    sources = cut(sources.join(scales(plain, sources), "of", "left"))  # a row a source
    if sources.count() <= BROADCAST_SOURCES:  # no task then gathers a large source's documents; more sources are each smaller
        sources = F.broadcast(sources)
    inclusion = F.when(F.col("left") <= 0, 0.0).when(F.col("size") > 0, F.least(F.lit(1.0), F.coalesce(F.col("scale") * F.col("size"), F.lit(1.0)))).otherwise(0.0)
    placed = plain.join(sources, "of").withColumn("inclusion", inclusion)
    p = F.col("inclusion")
    odds = F.when((p > 0) & (p < 1), F.col("u") * (1 - p) / ((1 - F.col("u")) * p))
    placed = placed.withColumn("odds", odds).withColumn("step", F.floor(F.log("odds") * steps).cast("int"))
    certain = placed.where("inclusion = 1").groupBy("of").agg(F.sum("size").alias("certain"))
    summed = placed.where("step is not null").groupBy("of", "step").agg(F.sum("size").alias("step_size")).join(certain, "of", "left")
    before = F.coalesce("certain", F.lit(0)) + F.coalesce(F.sum("step_size").over(W.partitionBy("of").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_step = summed.select("of", "step", before.alias("before"))
    in_step = W.partitionBy("of", "step").orderBy("odds", "u", F.col("doc_id").asc_nulls_last(), "size")
    ahead = F.col("before") + F.coalesce(F.sum("size").over(in_step.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.where("step is not null").join(by_step, ["of", "step"]).withColumn("more", (2 * ahead + F.col("size") <= 2 * F.col("left")).cast("int"))
    sure = placed.where("step is null").withColumn("more", (p == 1).cast("int"))
    taken = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    rows = ranked.drop("before").unionByName(sure).withColumn("copies", taken)
    return rows.select("doc_id", "source", "size", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tag")


def op7_source_mix(spark, sf_dir) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, (CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM t),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
         row_number() OVER (ORDER BY cap / weight, turn) AS place FROM w),
f AS (SELECT arg_min(rate, place) AS first_rate FROM r WHERE rate * weight <= cap),
g AS (SELECT source, source_size, coalesce(least(cap, first_rate * weight), cap) AS target FROM r, f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
k AS (SELECT *, target - whole * source_size AS rest FROM h),
n AS (SELECT source, size, sum(count(*)::DOUBLE * size) OVER upto AS words, sum(count(*)::DOUBLE * size * size) OVER upto AS squares FROM d WHERE size > 0 GROUP BY source, size
      WINDOW upto AS (PARTITION BY source ORDER BY size)),
e AS (SELECT k.source, arg_max((rest - (source_size - words)) / squares, size) AS scale FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source
      WHERE (rest - (source_size - words)) / squares * size <= 1 GROUP BY k.source),
i AS (SELECT d.doc_id, d.source, d.size, d.u, k.source_size, k.target, k.whole, k.rest,
         CASE WHEN rest <= 0 OR size = 0 THEN 0 ELSE least(1.0::DOUBLE, coalesce(scale * size, 1.0::DOUBLE)) END AS p
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM k.source),
o AS (SELECT *, CASE WHEN p = 0 THEN NULL WHEN p = 1 THEN 0 ELSE u * (1 - p) / ((1 - u) * p) END AS odds FROM i),
j AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, u, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p = 1 OR p > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
