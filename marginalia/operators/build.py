"""Whole jobs: projections of a corpus snapshot, a knowledge generation from extractions, and the points where users plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import embedding_text
from marginalia.operators import corpus as C
from marginalia.operators import knowledge as K
from marginalia.operators import retrieval as Q
from marginalia.sources import tables as S

CAPABILITIES: dict[str, Callable[..., DataFrame]] = {}


def capability(name: str):
    """Register a DataFrame function under a name; run it with apply_capability."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in CAPABILITIES:
            raise ValueError(f"{name!r} is registered already")
        CAPABILITIES[name] = function
        return function

    return register


def apply_capability(df: DataFrame, name: str, **parameters) -> DataFrame:
    if name not in CAPABILITIES:
        raise ValueError(f"no capability {name!r}")
    return df.transform(lambda rows: CAPABILITIES[name](rows, **parameters))


class Stages:
    """Functions from DataFrame to DataFrame by name."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, function: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.functions:
            raise ValueError(f"{name!r} is a stage already")
        self.functions[name] = function

    def run(self, df: DataFrame, names: list[str]) -> DataFrame:
        """The named stages in turn, each on what the one before made; a name without a function fails before any runs."""
        lost = [n for n in names if n not in self.functions]
        if lost:
            raise ValueError(f"no stage {', '.join(lost)}")
        for name in names:
            df = df.transform(self.functions[name])
        return df


def extract_chunks(chunks: DataFrame, extractor: Callable[[str], str], id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, bundle): a user's function from a text to a JSON bundle, run where the chunks lie; what it raises becomes a null bundle."""

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for text in rows["text"]:
                try:
                    found.append(extractor(text or ""))
                except Exception:
                    found.append(None)
            yield pd.DataFrame({"chunk_id": rows["chunk_id"], "bundle": found})

    return chunks.select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text")).mapInPandas(extracted, "chunk_id string, bundle string")


def source_details(chunks: DataFrame, documents: DataFrame, versions: DataFrame, logical: DataFrame) -> DataFrame:
    """Chunks with names of their document and version and, if there is one, their section, and a display line."""
    joined = chunks.join(documents.select("document_id", "title"), "document_id").join(versions.select("version_id", "source_filename"), "version_id")
    joined = joined.join(logical.select("logical_id", F.col("title").alias("section"), "page_start", "page_end"), "logical_id", "left")
    pages = F.when(F.col("page_start").isNotNull(), F.concat(F.lit("p. "), F.col("page_start").cast("string"), F.when(F.col("page_end") > F.col("page_start"), F.concat(F.lit("-"), F.col("page_end").cast("string"))).otherwise("")))
    return joined.withColumn("location", F.concat_ws(", ", "section", pages, F.concat(F.lit("passage "), (F.col("ordinal") + 1).cast("string"))))


def mirror_vectors(artifacts: DataFrame, units: DataFrame, documents: DataFrame, embed, dimension: int, config_hash: str, scope: dict[str, str], points: DataFrame | None = None) -> DataFrame:
    """Artifacts (artifact_id, unit_ids, text) as vectors with the sections they come from."""
    lineage = Q.artifact_lineage(artifacts, units, documents)
    vectors = C.embed_corpus(artifacts, embed, "artifact_id", "text", dimension).withColumnRenamed("id", "artifact_id")
    records = vectors.join(lineage, "artifact_id", "left").withColumns({k: F.lit(v) for k, v in scope.items()}).withColumns({"config_hash": F.lit(config_hash), "version": F.lit(1)})
    return S.upsert_vectors(points, records, dimension, config_hash, list(scope), ["artifact_id"])


def build_projections(corpus: DataFrame, path: str, generation: str, embed, dimension: int, config_hash: str) -> None:
    """Sparse and dense indexes of a snapshot (workspace_id, chunk_id, title, heading, content), under workspace and generation."""
    marked = corpus.withColumn("generation_id", F.lit(generation))
    scope = ["workspace_id", "generation_id"]
    postings, stats = Q.bm25_index(marked, "chunk_id", "content", scope)
    S.write_index(postings, stats, f"{path}/sparse", scope)
    texts = marked.select(*scope, "chunk_id", embedding_text(F.col("title"), F.col("heading"), F.col("content")).alias("text"))
    vectors = C.embed_corpus(texts, embed, "chunk_id", "text", dimension).withColumnRenamed("id", "chunk_id")
    records = vectors.join(texts.select(*scope, "chunk_id"), "chunk_id").withColumns({"config_hash": F.lit(config_hash), "version": F.lit(1)})
    S.write_scoped(S.upsert_vectors(None, records, dimension, config_hash, scope, ["chunk_id"]), f"{path}/dense", scope)


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table if it was written to its end."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.parquet(path) if there else None


def construct(chunks: DataFrame, extractor: Callable[[str], str], path: str, generation: str, entities: DataFrame | None = None, aliases: DataFrame | None = None, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """A knowledge generation from chunks (workspace_id, version_id, chunk_id, content): one Parquet table a stage.

    Stages that a former run has written are read, not run again, so a job that was stopped goes on where it was. Returns
    the tables by name: extraction, mentions, identity, entities, relations, temporals, participants, event_times, claims,
    rejects. `generation` names the folder; a new snapshot takes a new name. entities, aliases and resolved (mentions of former
    generations) are what mentions may be linked to.
    """
    spark = chunks.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    entities = entities if entities is not None else none("entity_id string, entity_type string, display_name string")
    aliases = aliases if aliases is not None else none("entity_id string, value string, active boolean")
    resolved = resolved if resolved is not None else none("entity_id string, evidence_id string, version_id string")
    tables: dict[str, DataFrame] = {}

    def stage(name: str, made: Callable[[], DataFrame]) -> DataFrame:
        place = f"{path}/{generation}/{name}"
        if _written(spark, place) is None:
            made().write.mode("overwrite").parquet(place)
        tables[name] = spark.read.parquet(place)
        return tables[name]

    bundles = stage("extraction", lambda: extract_chunks(chunks, extractor))
    parts, broken = S.parse_extractions(bundles)
    placed = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "version_id", "content")

    def mentions() -> DataFrame:
        spans = parts["mentions"].select(F.concat_ws("/", "chunk_id", "mention_id").alias("span_id"), "chunk_id", "start_offset", F.col("text").alias("quote"), "entity_type")
        aligned = K.align_spans(spans.drop("entity_type"), placed).join(spans.select("span_id", "entity_type"), "span_id")
        exact = aligned.join(placed, "chunk_id").where(K.exact_span(F.col("content"), F.col("start_offset"), F.col("quote")))
        return exact.select(F.col("span_id").alias("mention_id"), F.col("quote").alias("text"), "entity_type", "chunk_id", "version_id", "start_offset")

    held = stage("mentions", mentions)
    mapping = stage("identity", lambda: K.resolve_by_name(held, entities, aliases, resolved))
    stage("entities", lambda: K.build_entities(mapping.join(held, "mention_id")))
    mark = lambda c: F.concat_ws("/", "chunk_id", c)
    of = mapping.select("mention_id", "entity_id")
    ends = parts["relations"].withColumns({"source_mention": mark("source_mention"), "target_mention": mark("target_mention")})
    stage("relations", lambda: K.build_relations(ends, of)[0])
    times = stage("temporals", lambda: K.build_temporals(parts["temporals"].withColumn("temporal_id", mark("temporal_id")))[0])
    events = parts["events"].select(mark("event_id").alias("event_id"), "event_type", F.transform("participants", lambda p: F.struct(F.concat_ws("/", "chunk_id", p.getField("mention_id")).alias("mention_id"), p.getField("role").alias("role"))).alias("participants"), F.transform("temporal_ids", lambda t: F.concat_ws("/", "chunk_id", t)).alias("temporal_ids"))
    stage("participants", lambda: K.build_events(events, of, times)[0])
    stage("event_times", lambda: K.build_events(events, of, times)[1])
    stage("claims", lambda: K.build_claims(parts["claims"].withColumn("subject_mention", mark("subject_mention")), of))
    stage("rejects", lambda: broken)
    return tables
