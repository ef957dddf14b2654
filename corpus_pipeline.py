"""A corpus pipeline: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, exact, langid, minhash, mixing
from marginalia.llm.common import cut, documents, shared_dir

#: The least share of the best language for a document to stay.
LEAST_SHARE = 0.3


def _pick(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that `found` keeps (doc_id, tag, kept: a row for each row), one of those that repeat an id and its text.

    tag is the SHA-256 of the text, or null where any row of the id will do. Where no id repeats, which a count of the ids
    tells, rows are told apart by their id alone.
    """
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id_"), F.col("tag").alias("kept_tag_")).distinct()
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id_"]), "left_semi")
    marked = docs.withColumn("tag_", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = marked["doc_id"].eqNullSafe(kept["kept_id_"]) & F.coalesce(marked["tag_"] == kept["kept_tag_"], F.lit(True))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "tag_"]).drop("tag_")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those of null, empty or letterless text, and those that no language explains, go.

    Each row is judged by its text, so that repeated rows stay or go together, ids may be null, and no row is shuffled.
    Without any row that has a language all go; an empty table stays empty.
    """
    return langid.with_language(docs, LEAST_SHARE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest id. Even ids are the snapshot.

    Null text counts as empty. A null id is less than others; of rows that repeat an id and its text one stays. An empty
    table stays empty.
    """
    found = exact.dedup_batch(docs, exact.odd_ids())
    return _pick(docs, found.select("doc_id", F.col("text_sha256").alias("tag"), "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8): the one with the least id.

    Documents without words are duplicates of nothing, and documents without an id are not compared, so both stay. Of rows
    that repeat an id and its text one stays; an id of several texts stays if one of them does. An empty table stays empty.
    """
    found = minhash.near_duplicates(docs).select("doc_id", F.lit(None).cast("string").alias("tag"), "kept")
    return _pick(docs, found.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("string").alias("tag"), F.lit(True).alias("kept"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; without words never.

    Null sources are a source. Rows that repeat an id and its text are taken together: one of them stands for as many as
    the mix takes of all. An empty table stays empty.
    """
    taken = cut(mixing.mix_sources(docs).select("doc_id", "tag", "copies").groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies_"), F.count(F.lit(1)).alias("rows_")))
    wanted = taken.where("copies_ > 0").select(F.col("doc_id").alias("taken_id_"), F.col("tag").alias("taken_tag_"), "copies_")
    marked = docs.withColumn("tag_", mixing.text_tag("text"))
    if not taken.where("rows_ > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", "tag_"])
    joined = marked.join(wanted, marked["doc_id"].eqNullSafe(wanted["taken_id_"]) & (marked["tag_"] == wanted["taken_tag_"]))
    return joined.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int")))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; null text has none. Repeated rows each get
    their row, an empty table gives none."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("language ID", identify), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("mix", mix), ("byte-level BPE", encode)]
#: Language models, MinHash components and BPE merges aren't SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again by the next. Empty tables give no rows."""
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
