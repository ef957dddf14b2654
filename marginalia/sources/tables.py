"""Sources and sinks: corpus scans, files, artifacts, indexes, vectors. Stores are Parquet tables partitioned by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import stable_id
from marginalia.operators.relational import latest_per_key, require_scope
from marginalia.sources.store import Store

#: The kinds of an extraction bundle and their fields.
KIND_TYPES = {
    "mentions": "array<struct<mention_id:string,text:string,entity_type:string,start_offset:int>>",
    "relations": "array<struct<relation_id:string,source_mention:string,target_mention:string,relation_type:string>>",
    "events": "array<struct<event_id:string,event_type:string,participants:array<struct<mention_id:string,role:string>>,temporal_ids:array<string>>>",
    "temporals": "array<struct<temporal_id:string,original_text:string,normalized_start:string,normalized_end:string,precision:string>>",
    "claims": "array<struct<claim_id:string,subject_mention:string,predicate:string,value:string>>",
}
KINDS = tuple(KIND_TYPES)


def active_corpus(chunks: DataFrame, documents: DataFrame, workspace: str | None = None) -> DataFrame:
    """Chunks of the active versions of documents that aren't deleted, in no order; workspace prunes partitions."""
    docs = documents.where("deleted_at is null").select("workspace_id", "document_id", F.col("active_version_id").alias("version_id"))
    if workspace is not None:
        docs, chunks = docs.where(F.col("workspace_id") == workspace), chunks.where(F.col("workspace_id") == workspace)
    alive = chunks.where("deleted_at is null") if "deleted_at" in chunks.columns else chunks
    return alive.join(docs, ["workspace_id", "document_id", "version_id"], "left_semi")


def active_logical_documents(logical: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections of active versions; an active version without any stands for itself. Columns: document_id, version_id, logical_id, title, content."""
    alive = documents.where("deleted_at is null").select("document_id", F.col("active_version_id").alias("version_id"), "title")
    parts = logical.select("document_id", "version_id", "logical_id", "title", "content").join(alive.select("document_id", "version_id"), ["document_id", "version_id"], "left_semi")
    whole = alive.join(logical.select("version_id"), "version_id", "left_anti").join(versions.select("version_id", "content"), "version_id")
    return parts.unionByName(whole.select("document_id", "version_id", F.col("version_id").alias("logical_id"), "title", "content"))


def scan_population(entities: DataFrame, resource: str, mode: str = "exhaustive", safe_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, completeness) of a resource. discovery may be cut at safe_limit rows by record_id; completeness tells what is missing."""
    held = entities.where(F.col("resource") == resource)
    rows = held.orderBy("record_id").limit(safe_limit) if mode == "discovery" and safe_limit else held
    total = held.agg(F.count(F.lit(1)).alias("expected"))
    got = F.least("expected", F.lit(safe_limit)) if mode == "discovery" and safe_limit else F.col("expected")
    return rows, total.select(F.lit(resource).alias("resource"), F.lit(mode).alias("mode"), "expected", got.cast("long").alias("enumerated"), (got == F.col("expected")).alias("complete"))


def scan_populations(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, completeness) of every resource, each read in full; a null resource is one of its own."""
    total = entities.groupBy("resource").agg(F.count(F.lit(1)).alias("expected"))
    return entities, total.select("resource", F.lit("exhaustive").alias("mode"), "expected", F.col("expected").alias("enumerated"), F.lit(True).alias("complete"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text and reason of text files, each opened once: line ends as line feeds, empty files rejected with a reason."""
    files = spark.read.option("pathGlobFilter", "*.{txt,md,markdown}").option("recursiveFileLookup", True).text(path, wholetext=True)
    reason = F.when(~F.col("value").rlike(r"\S"), "empty")
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"), reason.alias("reason"))


def read_text_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of text files: line ends as line feeds, empty files rejected."""
    files = read_texts(spark, path)
    return files.where("reason is null").select("path", "text"), files.where("reason is not null").select("path", "reason")


#: Accepted extensions and the bytes that their files begin with, and what texts may be declared as.
FORMATS = {"pdf": b"%PDF-", "docx": b"PK\x03\x04", "txt": b"", "md": b""}
TEXT_TYPES = ("text/plain", "text/markdown", "application/octet-stream")


def classify_files(files: DataFrame, most_bytes: int = 50_000_000) -> DataFrame:
    """path, extension, accepted and reason of binary files (path, length, content and, if declared, media_type), from name, size, first bytes and type."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    expected = F.lit(None).cast("binary")
    for kind, magic in FORMATS.items():
        expected = F.when(extension == kind, F.lit(magic)).otherwise(expected)
    head = F.substring(F.col("content"), 1, 8)
    declared = F.lower(F.coalesce(F.col("media_type"), F.lit("application/octet-stream"))) if "media_type" in files.columns else F.lit("application/octet-stream")
    reason = (
        F.when(name.rlike(r"[\x00-\x1F]|^\.+$") | (F.length(name) > 255), "filename")
        .when(expected.isNull(), "extension")
        .when(F.col("length") > most_bytes, "size")
        .when(F.col("length") == 0, "empty")
        .when(~F.startswith(F.hex(head), F.hex(expected)), "content")
        .when(extension.isin("txt", "md") & ~declared.isin(*TEXT_TYPES), "media_type")
    )
    return files.select("path", extension.alias("extension"), reason.isNull().alias("accepted"), reason.alias("reason"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def graph_artifacts(table: DataFrame, kind: str, ids: list[str], texts: list[str]) -> DataFrame:
    """id, kind, text, attributes of a table whose id and text may be in any of several columns; all else becomes a text map."""
    have = set(table.columns)
    first = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    used = next((n for n in ids if n in have), None), next((n for n in texts if n in have), None)
    rest = [c for c in table.columns if c not in used]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), (F.to_json(F.col(c)) if table.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string")).alias("v")) for c in rest])
    known = F.filter(pairs, lambda p: p.getField("v").isNotNull()) if rest else None
    attributes = F.map_from_entries(known) if rest else F.create_map().cast("map<string,string>")
    return table.select(first(ids).alias("id"), F.lit(kind).alias("kind"), F.coalesce(first(texts), F.lit("")).alias("text"), attributes.alias("attributes"))


def read_graph_artifacts(spark: SparkSession, path: str, kind: str, ids: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    return graph_artifacts(spark.read.parquet(path), kind, ids or ["id", "human_readable_id"], texts or ["text", "description", "full_content", "summary"])


def newest_artifact(spark: SparkSession, path: str, name: str) -> str | None:
    """The Parquet file below `path` whose name holds `name` and whose path is greatest: names begin with what orders them. None without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{name}*.parquet").option("recursiveFileLookup", True).load(path)
    return files.agg(F.max("path")).first()[0]


def read_json_artifacts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.option("multiLine", True).schema("id string, text string, attributes map<string,string>").json(path)
    return rows.select("id", F.lit(kind).alias("kind"), "text", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def parse_extractions(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "bundle") -> tuple[dict[str, DataFrame], DataFrame]:
    """({kind: rows}, rejects) of extraction bundles in JSON, with the reason of each reject.

    A text is parsed once, to a variant, from which the kinds are taken. Rejected are texts that do not parse (json), that
    are no object (object), and bundles of which a kind is there but not as its schema says (the kind); the kinds of a rejected
    bundle are not taken. A kind that is absent or null has no rows, absent fields are null, and other fields are ignored.
    """
    parsed = rows.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("bundle"), F.try_parse_json(text_col).alias("v"))
    whole = lambda kind: F.try_variant_get("v", f"$.{kind}", KIND_TYPES[kind])
    there = lambda kind: F.schema_of_variant(F.try_variant_get("v", f"$.{kind}", "variant")) != "VOID"
    wrong = [F.when(F.coalesce(there(kind), F.lit(False)) & whole(kind).isNull(), F.lit(kind)) for kind in KINDS]
    reason = F.coalesce(F.when(F.col("v").isNull(), F.lit("json")), F.when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit("object")), *wrong)
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    out = {kind: good.select("chunk_id", F.inline(whole(kind))) for kind in KINDS}
    return out, judged.where("reason IS NOT NULL").select("chunk_id", "bundle", "reason")


def write_scoped(df: DataFrame, path: str, scope: list[str]) -> None:
    """A table partitioned by scope; of an existing one only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def write_manifest(corpus: DataFrame, path: str, generation: str) -> None:
    """What one generation was built from: chunk ids and hashes, under workspace and generation."""
    rows = corpus.select("workspace_id", F.lit(generation).alias("generation_id"), "document_id", "version_id", "chunk_id", F.sha2("content", 256).alias("content_hash"))
    write_scoped(rows, path, ["workspace_id", "generation_id"])


def write_index(postings: DataFrame, stats: DataFrame, path: str, scope: list[str]) -> None:
    write_scoped(postings, f"{path}/postings", scope)
    write_scoped(stats, f"{path}/statistics", scope)


def read_index(spark: SparkSession, path: str, scope: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The index of one scope; a row of another fails the read, and so does a scope that was never written."""
    held = []
    for part in ("postings", "statistics"):
        rows = spark.read.parquet(f"{path}/{part}")
        for field, value in scope.items():
            rows = rows.where(F.col(field) == value)
        held.append(require_scope(rows, scope))
    if held[1].isEmpty():
        raise ValueError(f"no index of {scope}")
    return held[0], held[1]


def checked_vectors(records: DataFrame, dimension: int, config_hash: str, scope: list[str], key: list[str]) -> DataFrame:
    """One record a point, with the point_id that follows from scope and key.

    A record of another dimension or embedding configuration fails the job; of records of one id the last by `version` counts,
    of equal versions the one with the greatest vector.
    """
    size = F.assert_true(F.size("embedding") == dimension, F.lit(f"embedding is not of {dimension} numbers"))
    config = F.assert_true(F.col("config_hash") == config_hash, F.lit("another embedding configuration"))
    checked = records.where(F.coalesce(size.cast("string"), config.cast("string")).isNull())
    named = checked.withColumn("point_id", stable_id(*[F.col(c) for c in (*scope, *key)]))
    return latest_per_key(named, ["point_id"], ["version", "embedding"])


def upsert_vectors(points: DataFrame | None, records: DataFrame, dimension: int, config_hash: str, scope: list[str], key: list[str]) -> DataFrame:
    """points with records in place of those of the same id, as checked_vectors() takes them."""
    last = checked_vectors(records, dimension, config_hash, scope, key)
    if points is None:
        return last
    return points.join(last.select("point_id"), "point_id", "left_anti").unionByName(last, allowMissingColumns=True)


def store_vectors(store: Store, number: int, records: DataFrame, dimension: int, config_hash: str, scope: list[str], key: list[str], writer: str = "vectors") -> bool:
    """upsert_vectors() into a store's table `vectors`; False if this number of the writer is there already."""
    return store.change(writer, number, {"vectors": (checked_vectors(records, dimension, config_hash, scope, key), ["point_id"])})


def write_corpus_text(docs: DataFrame, path: str, header: list[str], content: str = "content") -> None:
    """Documents as text files with a header of their fields."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{h}: "), F.col(h).cast("string")) for h in header], F.lit(""), F.col(content))
    docs.select(lines.alias("value")).write.mode("overwrite").text(path)


def graph_tables(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of artifacts: parallel edges stay apart, ends become nodes."""
    edges = relationships.select(F.col("id").alias("edge_id"), F.col("attributes")["source"].alias("source"), F.col("attributes")["target"].alias("target"), "text")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null")
    named = entities.select(F.coalesce(F.col("attributes")["title"], F.col("id")).alias("node"), "text")
    nodes = named.unionByName(ends.withColumn("text", F.lit(None).cast("string"))).groupBy("node").agg(F.max("text").alias("text"))
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, generation: str) -> None:
    """Both tables as Parquet under their generation."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        write_scoped(table.withColumn("generation_id", F.lit(generation)), f"{path}/{name}", ["generation_id"])


def read_graph(spark: SparkSession, path: str, generation: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = (spark.read.parquet(f"{path}/{name}").where(F.col("generation_id") == generation) for name in ("nodes", "edges"))
    return nodes, edges
