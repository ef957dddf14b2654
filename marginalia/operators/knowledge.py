"""Knowledge construction: spans, identity, claims, merges, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import comparable_name, normalized_mention, stable_id
from marginalia.operators.relational import paired_classes, paired_members
from marginalia.sources.session import materialize
from marginalia.sources.store import Store
from marginalia.sources.tables import write_scoped

#: Stages that a generation must have ready.
STAGES = ("snapshot", "extraction", "identity", "relations", "temporals", "events", "claims", "canonical_graph", "sparse_index", "dense_index", "extracted_graph")


def align_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """start_offset moved to the nearest occurrence of the quote; two equally near, or none, leave it.

    spans: span_id, chunk_id, start_offset, quote; chunks: chunk_id, content.
    """
    joined = spans.join(chunks.select("chunk_id", "content"), "chunk_id")
    # the text cut before each occurrence, overlapping ones too: a piece begins where those before it end
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(F.col("quote"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.when(F.length("quote") > 0, F.split(F.col("content"), literal)).otherwise(F.array("content"))
    begins = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    starts = F.filter(F.arrays_zip(pieces.alias("p"), begins.alias("b")), lambda z: F.startswith(z.getField("p"), F.col("quote")) & (F.length("quote") > 0))
    at = F.transform(starts, lambda z: z.getField("b"))
    far = F.transform("places", lambda p: F.abs(p - F.col("start_offset")))
    placed = joined.withColumn("places", at).withColumn("near", F.array_min(far))
    best = F.filter("places", lambda p: F.abs(p - F.col("start_offset")) == F.col("near"))
    return placed.select("span_id", "chunk_id", F.when(F.size(best) == 1, F.get(best, F.lit(0))).otherwise(F.col("start_offset")).alias("start_offset"), "quote")


def exact_span(content: Column, start: Column, quote: Column) -> Column:
    """Whether the content has the quote at the offset."""
    return F.coalesce((start >= 0) & (F.substring(content, start + 1, F.length(quote)) == quote), F.lit(False))


def retain_exact(mentions: DataFrame, dependents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept mentions, kept dependents, counts): mentions whose quote is exact, dependents all of whose mentions stay.

    mentions: mention_id, chunk_id, start_offset, quote; dependents: dependent_id, mention_ids.
    """
    kept = mentions.join(chunks.select("chunk_id", "content"), "chunk_id").where(exact_span(F.col("content"), F.col("start_offset"), F.col("quote"))).drop("content")
    lost = dependents.select("dependent_id", F.explode("mention_ids").alias("mention_id")).join(kept.select("mention_id"), "mention_id", "left_anti")
    stay = dependents.join(lost.select("dependent_id").distinct(), "dependent_id", "left_anti")
    count = lambda df, kind, state: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(state).alias("state"), "n")
    counts = count(mentions, "mention", "given").unionByName(count(kept, "mention", "kept")).unionByName(count(dependents, "dependent", "given")).unionByName(count(stay, "dependent", "kept"))
    return kept, stay, counts


def validate_extraction(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with reasons): a rule is a column that is true where a row is valid."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def _supported(entities: DataFrame, aliases: DataFrame, resolved: DataFrame, ascii_only: bool) -> DataFrame:
    """(entity_id, entity_type, name, evidences, versions): the names of entities and what supports them."""
    norm = lambda c: normalized_mention(F.col(c), ascii_only)
    names = entities.select("entity_id", "entity_type", norm("display_name").alias("name"))
    more = aliases.where("active").join(entities.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", norm("value").alias("name"))
    support = resolved.groupBy("entity_id").agg(F.count_distinct("evidence_id").alias("evidences"), F.count_distinct("version_id").alias("versions"))
    known = names.unionByName(more).distinct().join(support, "entity_id", "left")
    return known.select("entity_id", "entity_type", "name", F.coalesce("evidences", F.lit(0)).alias("evidences"), F.coalesce("versions", F.lit(0)).alias("versions"))


def _asked(mentions: DataFrame, ascii_only: bool) -> tuple[DataFrame, DataFrame | None]:
    """(mention_id, entity_type, name) of mentions, and the ids of those that have several types or names (None: there are none)."""
    asked = mentions.select("mention_id", "entity_type", normalized_mention(F.col("text"), ascii_only).alias("name")).distinct()
    several = materialize(asked.groupBy("mention_id").count().where("count > 1").select("mention_id"))
    return asked, None if several.isEmpty() else several


def identity_candidates(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, resolved: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Entities of a mention's type whose name or active alias equals it, with the support of each.

    mentions: mention_id, text, entity_type; entities: entity_id, entity_type, display_name; aliases: entity_id, value, active;
    resolved: entity_id, evidence_id, version_id, of the mentions that have been resolved to an entity before. Returns
    mention_id, entity_id, evidences, versions: how many distinct ones support the entity; new mentions support nothing.
    Pairs are dealt evenly and not shuffled, but for mentions of several types or names, whose pairs may be found twice.
    """
    known = _supported(entities, aliases, resolved, ascii_only)
    asked, several = _asked(mentions, ascii_only)

    def met(some: DataFrame) -> DataFrame:
        classes = paired_classes(some, known, ["entity_type", "name"], "mention_id", "entity_id")
        return paired_members(classes, "mention_id", "entity_id").select("mention_id", "entity_id", "evidences", "versions")

    if several is None:
        return met(asked)
    return met(asked.join(several, "mention_id", "left_anti")).unionByName(met(asked.join(several, "mention_id", "left_semi")).distinct())


def resolve_mentions(mentions: DataFrame, candidates: DataFrame, least: int = 2) -> DataFrame:
    """A mention is linked only if one candidate alone has `least` evidences and versions; without candidates it founds an entity.

    Returns mention_id, decision (linked, unresolved or new), entity_id.
    """
    ok = (F.col("evidences") >= least) & (F.col("versions") >= least)
    judged = candidates.groupBy("mention_id").agg(F.count_if(ok).alias("sure"), F.count(F.lit(1)).alias("n"), F.min(F.when(ok, F.col("entity_id"))).alias("best"))
    return _decided(mentions.join(judged, "mention_id", "left"))


def _decided(joined: DataFrame) -> DataFrame:
    decision = F.when(F.col("n").isNull(), "new").when(F.col("sure") == 1, "linked").otherwise("unresolved")
    own = stable_id(F.col("entity_type"), normalized_mention(F.col("text"), True))
    entity = F.when(F.col("n").isNull(), own).when(F.col("sure") == 1, F.col("best").cast("string"))
    return joined.select("mention_id", decision.alias("decision"), entity.alias("entity_id"))


def resolve_by_name(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, resolved: DataFrame, ascii_only: bool = False, least: int = 2) -> DataFrame:
    """resolve_mentions() of identity_candidates() without their pairs: a name's candidates are judged once for all its mentions."""
    asked, several = _asked(mentions, ascii_only)
    ok = (F.col("evidences") >= least) & (F.col("versions") >= least)
    names = _supported(entities, aliases, resolved, ascii_only).groupBy("entity_type", "name")
    judged = names.agg(F.count_if(ok).alias("sure"), F.count(F.lit(1)).alias("n"), F.min(F.when(ok, F.col("entity_id"))).alias("best"))
    alone = mentions if several is None else mentions.join(several, "mention_id", "left_anti")
    joined = alone.withColumn("name", F.when(F.col("mention_id").isNotNull(), normalized_mention(F.col("text"), ascii_only))).join(judged, ["entity_type", "name"], "left")
    found = _decided(joined)
    if several is None:
        return found
    rest = mentions.join(several, "mention_id", "left_semi")
    return found.unionByName(resolve_mentions(rest, identity_candidates(rest, entities, aliases, resolved, ascii_only), least))


def build_entities(mapped: DataFrame) -> DataFrame:
    """Entities of resolved mentions (entity_id, entity_type, mention_id, text): the first text is the name, all are aliases."""
    return mapped.where("entity_id is not null").groupBy("entity_id", "entity_type").agg(
        F.min_by("text", "mention_id").alias("display_name"), F.count(F.lit(1)).alias("n_mentions"), F.sort_array(F.collect_set("text")).alias("aliases")
    )


def build_relations(relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations between entities, rejects): ends are mentions; mapping: mention_id, entity_id."""
    end = lambda side: mapping.where("entity_id is not null").select(F.col("mention_id").alias(f"{side}_mention"), F.col("entity_id").alias(f"{side}_entity_id"))
    joined = relations.join(end("source"), "source_mention", "left").join(end("target"), "target_mention", "left")
    ok = F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()
    return joined.where(ok), joined.where(~ok)


def build_temporals(temporals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid temporals, rejects): the range must not be backwards and an exact precision needs a start."""
    start, end = F.col("normalized_start"), F.col("normalized_end")
    rules = {"backwards": end.isNull() | (start <= end), "no_start": (F.col("precision") == "unknown") | start.isNotNull(), "no_text": F.length("original_text") > 0}
    return validate_extraction(temporals, rules)


def build_events(events: DataFrame, mapping: DataFrame, temporals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(participants of events by entity, event-time links). events: event_id, participants array<struct<mention_id, role>>, temporal_ids."""
    spread = events.select("event_id", F.explode("participants").alias("p")).select("event_id", "p.mention_id", "p.role")
    people = spread.join(mapping.where("entity_id is not null"), "mention_id").select("event_id", "entity_id", "role").distinct()
    links = events.select("event_id", F.explode("temporal_ids").alias("temporal_id")).distinct().join(temporals.select("temporal_id"), "temporal_id", "left_semi")
    return people, links


def build_claims(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """Claims with their subject as an entity."""
    return claims.join(mapping.where("entity_id is not null").withColumnRenamed("mention_id", "subject_mention").withColumnRenamed("entity_id", "subject_id"), "subject_mention")


def advance_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims after decisions (claim_id, to_stage, evidence_count, reviewer): extracted to supported to verified, a step at a time.

    Support needs evidence, verification a reviewer; what breaks a rule leaves the stage and is flagged.
    """
    joined = claims.join(decisions, "claim_id", "left")
    step = F.concat_ws(">", "stage", "to_stage")
    ok = ((step == "extracted>supported") & (F.col("evidence_count") > 0)) | ((step == "supported>verified") & F.col("reviewer").isNotNull())
    asked = F.col("to_stage").isNotNull()
    return joined.withColumns({"stage": F.when(asked & F.coalesce(ok, F.lit(False)), F.col("to_stage")).otherwise(F.col("stage")), "violation": asked & ~F.coalesce(ok, F.lit(False))}).drop("to_stage", "evidence_count", "reviewer")


def split_entities(entities: DataFrame, mentions: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, checks): mentions of a split entity go where assignments (entity_id, mention_id, new_entity_id) say.

    A split is done only if every mention of the entity is assigned exactly once; checks tell.
    """
    wanted = assignments.select("entity_id").distinct()
    mine = mentions.join(wanted, "entity_id", "left_semi").select("entity_id", "mention_id")
    given = assignments.groupBy("entity_id", "mention_id").agg(F.count(F.lit(1)).alias("n"))
    joined = mine.withColumn("_m", F.lit(True)).join(given, ["entity_id", "mention_id"], "full")
    checks = joined.groupBy("entity_id").agg(F.every(F.coalesce(F.col("_m") & (F.col("n") == 1), F.lit(False))).alias("complete"))
    done = checks.where("complete").select("entity_id")
    new = assignments.join(done, "entity_id", "left_semi").select(F.col("mention_id").alias("_m"), F.col("entity_id").alias("_e"), "new_entity_id")
    moved = mentions.join(new, (F.col("mention_id") == F.col("_m")) & (F.col("entity_id") == F.col("_e")), "left").withColumn("entity_id", F.coalesce("new_entity_id", "entity_id")).drop("_m", "_e", "new_entity_id")
    split = entities.join(done.withColumn("_s", F.lit(True)), "entity_id", "left").withColumn("status", F.when(F.col("_s"), "split").otherwise(F.col("status"))).drop("_s")
    kinds = assignments.join(done, "entity_id", "left_semi").join(entities.select("entity_id", "entity_type"), "entity_id")
    born = kinds.select(F.col("new_entity_id").alias("entity_id"), "entity_type", F.lit("active").alias("status")).distinct()
    return split.unionByName(born, allowMissingColumns=True), moved, checks


def apply_alias_ops(aliases: DataFrame, operations: DataFrame) -> DataFrame:
    """Aliases (entity_id, value, active) after add and remove operations (entity_id, value, action, seq): the latest counts."""
    last = operations.groupBy("entity_id", "value").agg(F.max_by("action", "seq").alias("action"))
    joined = aliases.join(last, ["entity_id", "value"], "full")
    return joined.select("entity_id", "value", F.coalesce(F.col("action") == "add", F.col("active")).alias("active"))


def entity_catalog(entities: DataFrame, aliases: DataFrame, generation: str | None = None) -> DataFrame:
    """Entities with their active aliases in order, of one generation or of all."""
    held = entities.where(F.col("generation_id") == generation) if generation else entities
    names = aliases.where("active").groupBy("entity_id").agg(F.sort_array(F.collect_set("value")).alias("aliases"))
    return held.join(names, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def link_mentions(mentions: DataFrame, catalog: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Exact-name linking within a mention's type (`unknown`: any): resolved with one entity, ambiguous with more, unknown with none.

    mentions: mention_id, text, entity_type; catalog: entity_id, entity_type, display_name, aliases.
    """
    norm = lambda c: normalized_mention(c, ascii_only)
    known = catalog.select("entity_id", "entity_type", F.explode(F.array_append("aliases", F.col("display_name"))).alias("n")).select("entity_id", "entity_type", norm(F.col("n")).alias("name")).distinct()
    any_type = known.select("entity_id", F.lit("unknown").alias("entity_type"), "name").distinct()
    names = known.where("entity_type <> 'unknown'").unionByName(any_type).groupBy("entity_type", "name").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id"))
    joined = mentions.withColumn("name", norm(F.col("text"))).join(names, ["entity_type", "name"], "left")
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return joined.select("mention_id", state.alias("state"), F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"))


#: Fixed value: two to four capitalised words in a row.
NAME = r"(?<![\p{L}\p{N}_])((?:[A-ZÇĞİÖŞÜ][\p{L}\p{N}_'’.-]+\s+){1,3}[A-ZÇĞİÖŞÜ][\p{L}\p{N}_'’.-]+)(?![\p{L}\p{N}_])"


#: Terms of ownership and law, runs of numbers, and how many candidates a mention has.
NAME_TERMS = ("malik", "hisse", "tapu", "miras", "vekal", "tescil", "gayrimenkul")
NUMBERS = r"(?:^|\s)\d[\d. ,/-]{5,}(?:\s|$)"
MOST_NAMES = 12
#: Fixed values, in hundredths: what a full name scores, what each document and each passage adds up to a limit, what
#: descriptive passages and metadata add, and what numbers in all passages take away.
NAME_SCORE, BY_DOCUMENT, BY_PASSAGE, DESCRIBED, IN_METADATA, ALL_NUMBERS = 73, (4, 12), (2, 8), 6, 8, -18


def rank_names(mentions: DataFrame, chunks: DataFrame, people: DataFrame | None = None, threshold: float = 0.72, margin: float = 0.08, most: int = MOST_NAMES) -> DataFrame:
    """Full names in the corpus that have all of a mention's words, scored by support; resolved if the best is good and clear.

    mentions: mention_id, text; chunks: chunk_id, document_id, content; people: name, as metadata have them. Words are compared
    without a title, in lower case. A name gains by its documents and passages (each place it is named), by a passage of
    descriptive terms, and by metadata, and loses if all its passages hold runs of numbers; ties go to more documents, then
    to the name. A mention's first word finds the names, whose words are then compared. Returns mention_id, name, score (0 to
    0.99), documents, passages, basis, rank (up to `most`), resolved.
    """
    found = chunks.select("document_id", "content", F.explode(F.regexp_extract_all("content", F.lit(NAME), F.lit(1))).alias("name"))
    described = F.lower("content").rlike("|".join(NAME_TERMS))
    names = found.groupBy("name").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("passages"), F.some(described).alias("described"), F.every(F.col("content").rlike(NUMBERS)).alias("numbers"))
    known = people.select("name").distinct().withColumn("known", F.lit(True)) if people is not None else names.select("name", F.lit(True).alias("known")).limit(0)
    tokens = lambda c: F.array_distinct(F.filter(F.split(comparable_name(F.col(c)), r"\s+"), lambda x: x != ""))
    names = names.join(known, "name", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("words", tokens("name"))
    size = F.size(F.split(F.trim(comparable_name(F.col("name"))), r"\s+"))
    asked = mentions.select("mention_id", tokens("text").alias("wanted")).withColumn("word", F.get("wanted", F.lit(0)))
    joined = names.where(size >= 2).withColumn("word", F.explode("words")).join(asked, "word").where(F.size(F.array_except("wanted", "words")) == 0)
    part = lambda count, rule: F.least(F.lit(rule[1]), F.col(count) * rule[0])
    either = lambda c, n: F.when(F.col(c), n).otherwise(0)
    points = F.greatest(F.lit(0), F.least(F.lit(99), NAME_SCORE + part("documents", BY_DOCUMENT) + part("passages", BY_PASSAGE) + either("described", DESCRIBED) + either("known", IN_METADATA) + either("numbers", ALL_NUMBERS))).cast("int")
    basis = F.array_compact(F.array(F.lit("full_name_token"), F.concat(F.lit("documents:"), F.col("documents").cast("string")), F.when(F.col("described"), F.lit("descriptive_context")), F.when(F.col("known"), F.lit("metadata"))))
    w = W.partitionBy("mention_id").orderBy(F.col("points").desc(), F.col("documents").desc(), "name")
    ranked = joined.withColumns({"points": points, "basis": basis}).withColumns({"rank": F.row_number().over(w), "_next": F.lead("points").over(w)}).where(F.col("rank") <= most)
    clear = F.col("_next").isNull() | (F.col("points") - F.col("_next") >= round(100 * margin))
    resolved = (F.col("rank") == 1) & (F.col("points") >= round(100 * threshold)) & clear
    return ranked.select("mention_id", "name", (F.col("points") / 100).alias("score"), "documents", "passages", "basis", "rank", resolved.alias("resolved"))


def extracted_issues(nodes: DataFrame, edges: DataFrame, generation: str) -> DataFrame:
    """(issue, id): what keeps an extracted layer from being written: duplicate ids, missing ends, rows of other generations; none if it may."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate_node").alias("issue"), F.col("node").cast("string").alias("id"))
    edge_twice = edges.groupBy("edge_id").count().where("count > 1").select(F.lit("duplicate_edge").alias("issue"), F.col("edge_id").cast("string").alias("id"))
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("node")).join(nodes.select("node").distinct(), "node", "left_anti")
    lost = ends.select(F.lit("missing_end").alias("issue"), F.col("edge_id").cast("string").alias("id")).distinct()
    other = nodes.where(F.col("generation_id") != generation).select(F.lit("other_generation").alias("issue"), F.col("node").cast("string").alias("id"))
    return twice.unionByName(edge_twice).unionByName(lost).unionByName(other)


def replace_extracted(nodes: DataFrame, edges: DataFrame, generation: str, path: str) -> None:
    """Put nodes and edges in place of the extracted layer of their generation at `path`; other generations stay as they are.

    Nothing is written where extracted_issues() finds something. Partitions are overwritten dynamically.
    """
    found = extracted_issues(nodes, edges, generation).limit(5).collect()
    if found:
        raise ValueError("the layer can't be written: " + ", ".join(f"{r.issue} {r.id}" for r in found))
    for name, table in (("nodes", nodes), ("edges", edges)):
        write_scoped(table.withColumn("generation_id", F.lit(generation)), f"{path}/{name}", ["generation_id"])


def store_extracted(store: Store, number: int, nodes: DataFrame, edges: DataFrame, generation: str, writer: str = "layers") -> bool:
    """replace_extracted() in a store: both tables of a generation move at once, and a number that was done does nothing."""
    found = extracted_issues(nodes, edges, generation).limit(5).collect()
    if found:
        raise ValueError("the layer can't be written: " + ", ".join(f"{r.issue} {r.id}" for r in found))
    own = F.col("generation_id") == generation
    mark = lambda df: df.withColumn("generation_id", F.lit(generation))
    return store.change(writer, number, {"nodes": (mark(nodes), ["generation_id", "node"]), "edges": (mark(edges), ["generation_id", "edge_id"])}, {"nodes": own, "edges": own})


def generation_ready(generations: DataFrame, stages: DataFrame, names: tuple[str, ...] = STAGES) -> DataFrame:
    """Whether each generation has all stages ready, from one input and with an output; active is the newest ready one of its workspace."""
    good = (F.col("state") == "ready") & (F.col("input_fingerprint") == F.col("source_fingerprint")) & F.col("output_fingerprint").isNotNull()
    joined = stages.where(F.col("stage").isin(*names)).join(generations, "generation_id", "right")
    judged = joined.groupBy("generation_id", "workspace_id", "created_at").agg(F.count_distinct(F.when(good, F.col("stage"))).alias("ready_stages"))
    ready = judged.withColumn("ready", F.col("ready_stages") == len(names))
    newest = ready.where("ready").groupBy("workspace_id").agg(F.max_by("generation_id", F.struct("created_at", "generation_id")).alias("_active"))
    return ready.join(newest, "workspace_id", "left").withColumn("active", F.coalesce(F.col("generation_id") == F.col("_active"), F.lit(False))).drop("_active")


def cutover_report(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Rows with accepted and the names of the gates that failed."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()]))
    return rows.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
