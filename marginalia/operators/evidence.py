"""Evidence reconciliation over many answer packages at once; every table carries package_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.knowledge import exact_span

P = "package_id"


def check_boundaries(results: DataFrame, steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(package_id, issue, subject): workspaces that mix, steps with two results, results of undeclared steps, sources listed twice.

    results: package_id, step_id, workspace_id; steps: package_id, step_id; sources: package_id, source_id.
    """
    issue = lambda df, name, subject: df.select(P, F.lit(name).alias("issue"), F.col(subject).cast("string").alias("subject"))
    mixed = results.groupBy(P).agg(F.count_distinct("workspace_id").alias("n")).where("n > 1").withColumn("none", F.lit(None))
    doubled = results.groupBy(P, "step_id").count().where("count > 1")
    undeclared = results.select(P, "step_id").distinct().join(steps.select(P, "step_id"), [P, "step_id"], "left_anti")
    repeated = sources.groupBy(P, "source_id").count().where("count > 1")
    return issue(mixed, "mixed_workspaces", "none").unionByName(issue(doubled, "duplicate_result", "step_id")).unionByName(issue(undeclared, "undeclared_step", "step_id")).unionByName(issue(repeated, "duplicate_source", "source_id"))


def validate_evidence(evidence: DataFrame, sources: DataFrame, generation: str) -> tuple[DataFrame, DataFrame]:
    """(valid spans, issues). Evidence of another generation, of an unknown source, or whose text is not at its offset is an issue,
    and so is an id that stands for two spans. Valid evidence of one span becomes a row with the best scores and all steps.

    evidence: package_id, evidence_id, step_id, chunk_id, version_id, generation_id, start_offset, source_text, relevance,
    quality; sources: chunk_id, version_id, content.
    """
    joined = evidence.join(sources.select("chunk_id", "version_id", "content"), ["chunk_id", "version_id"], "left")
    span = F.struct("chunk_id", "version_id", "start_offset", "source_text")
    clash = evidence.groupBy(P, "evidence_id").agg(F.count_distinct(span).alias("_spans")).where("_spans > 1").select(P, "evidence_id", F.lit(True).alias("_clash"))
    joined = joined.join(clash, [P, "evidence_id"], "left")
    issue = (
        F.when(F.col("_clash"), "conflicting_id")
        .when(~F.col("generation_id").eqNullSafe(F.lit(generation)), "other_generation")
        .when(F.col("content").isNull(), "unknown_source")
        .when(~exact_span(F.col("content"), F.col("start_offset"), F.col("source_text")), "inexact_span")
    )
    judged = joined.withColumn("issue", issue)
    valid = judged.where("issue is null").groupBy(P, "chunk_id", "version_id", "start_offset", "source_text").agg(
        F.min("evidence_id").alias("evidence_id"), F.sort_array(F.collect_set("evidence_id")).alias("aliases"), F.max("relevance").alias("relevance"), F.max("quality").alias("quality"), F.sort_array(F.collect_set("step_id")).alias("steps")
    )
    return valid, judged.where("issue is not null").select(P, "evidence_id", "issue")


def reconcile_items(items: DataFrame, valid: DataFrame, order: str = "value") -> tuple[DataFrame, DataFrame]:
    """(items, conflicts): items with valid evidence, once for each id and value, and ids that have other values than their first.

    items: package_id, item_id, value, evidence_ids, and `order`, by which an id's first value is found (the least, unless told
    otherwise); valid: as of validate_evidence. An item keeps the valid spans of all rows that agree in id and value; rows
    without any are gone. Different ids stay apart, whatever their values. conflicts: package_id, item_id, left_value (the
    first), right_value, one for each other value.
    """
    named = valid.select(P, F.col("evidence_id").alias("_kept"), F.explode("aliases").alias("_id"))
    spread = items.select(P, "item_id", "value", F.col(order).alias("_order"), F.explode("evidence_ids").alias("_id"))
    merged = spread.join(named, [P, "_id"]).groupBy(P, "item_id", "value").agg(F.sort_array(F.collect_set("_kept")).alias("evidence_ids"), F.min("_order").alias("_order"))
    firsts = merged.groupBy(P, "item_id").agg(F.min_by("value", F.struct("_order", "value")).alias("left_value"))
    clash = merged.join(firsts, [P, "item_id"]).where(~F.col("value").eqNullSafe(F.col("left_value")))
    return merged.drop("_order"), clash.select(P, "item_id", "left_value", F.col("value").alias("right_value"))


def rank_citations(valid: DataFrame) -> DataFrame:
    """Citations numbered by 0.6 relevance + 0.3 quality + 0.1 for up to three steps, the greatest first; ties by id, the greatest
    first. The score that is shown ends at 1."""
    score = F.col("relevance") * 0.6 + F.col("quality") * 0.3 + F.least(F.size("steps"), F.lit(3)) / 3 * 0.1
    scored = valid.withColumn("_score", score)
    ranked = scored.withColumn("citation", F.row_number().over(W.partitionBy(P).orderBy(F.col("_score").desc(), F.col("evidence_id").desc())))
    return ranked.withColumn("citation_score", F.least(F.lit(1.0), F.round("_score", 6))).drop("_score")


def valid_links(links: DataFrame, valid: DataFrame) -> DataFrame:
    """Provenance links (package_id, artifact_id, evidence_ids) with their valid evidence only; links without any are gone."""
    named = valid.select(P, F.col("evidence_id").alias("_kept"), F.explode("aliases").alias("_id"))
    spread = links.select(P, "artifact_id", F.explode("evidence_ids").alias("_id")).join(named, [P, "_id"])
    return spread.groupBy(P, "artifact_id").agg(F.sort_array(F.collect_set("_kept")).alias("evidence_ids"))


def completeness(contract: DataFrame, steps: DataFrame, results: DataFrame, failures: DataFrame, issues: DataFrame) -> DataFrame:
    """How complete each package is, for the packages of the contract.

    contract: package_id, generation_id, coverage, mandatory_projections; steps: package_id, step_id, required,
    generation_required; results: package_id, step_id, state, generation_id, completeness, candidate_count, processed_count,
    ready_projections, missing_projections; failures and issues: package_id. A package is complete if its coverage is exhaustive,
    all its results are successful and complete, all required steps have one, no projection is missing, and there is no
    failure and no issue; else partial if it has results, else unknown. A result of another generation than the contract's, of
    a step that needs it, is an issue of its own (generation_mismatch). Counts are null where no result has any.
    """
    none = F.array().cast("array<string>")
    judged = results.join(steps.select(P, "step_id", "generation_required"), [P, "step_id"], "left").join(contract.select(P, F.col("generation_id").alias("_wanted")), P)
    other = F.coalesce(F.col("generation_required"), F.lit(False)) & F.col("_wanted").isNotNull() & ~F.col("generation_id").eqNullSafe(F.col("_wanted"))
    seen = judged.groupBy(P).agg(
        F.every((F.col("state") == "success") & (F.col("completeness") == "complete")).alias("_all"), F.sum("candidate_count").alias("candidate_count"), F.sum("processed_count").alias("processed_count"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("ready_projections", none)))).alias("_ready"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("missing_projections", none)))).alias("_missing"),
        F.collect_set("step_id").alias("_steps"), F.some(other).alias("_other"),
    )
    required = steps.where("required").groupBy(P).agg(F.collect_set("step_id").alias("_required"))
    flag = lambda df, name: df.select(P).distinct().withColumn(name, F.lit(True))
    joined = contract.join(seen, P, "left").join(required, P, "left").join(flag(failures, "_failed"), P, "left").join(flag(issues, "_issue"), P, "left")
    ready, steps_seen = F.coalesce("_ready", none), F.coalesce("_steps", none)
    missing = F.array_distinct(F.concat(F.array_except(F.coalesce("mandatory_projections", none), ready), F.coalesce("_missing", none)))
    mismatch = F.coalesce("_other", F.lit(False))
    complete = (F.col("coverage") == "exhaustive") & F.coalesce("_all", F.lit(False)) & F.col("_failed").isNull() & F.col("_issue").isNull() & (F.size(missing) == 0) & ~mismatch & (F.size(F.array_except(F.coalesce("_required", none), steps_seen)) == 0)
    state = F.when(F.coalesce(complete, F.lit(False)), "complete").when(F.col("_steps").isNotNull(), "partial").otherwise("unknown")
    return joined.select(P, state.alias("state"), "candidate_count", "processed_count", F.array_sort(ready).alias("ready_projections"), F.array_sort(missing).alias("missing_projections"), mismatch.alias("generation_mismatch"))


def source_issues(contract: DataFrame, valid: DataFrame) -> DataFrame:
    """(package_id, sources): packages with fewer sources of valid evidence (version and chunk) than the contract's minimum_sources."""
    counts = valid.select(P, "version_id", "chunk_id").distinct().groupBy(P).agg(F.count(F.lit(1)).alias("sources"))
    joined = contract.select(P, "minimum_sources").join(counts, P, "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return joined.where("sources < minimum_sources").select(P, "sources")


def answer_state(contract: DataFrame, results: DataFrame, complete: DataFrame, items: DataFrame, valid: DataFrame, ambiguities: DataFrame, failures: DataFrame, issues: DataFrame) -> DataFrame:
    """ambiguous, corpus_complete, grounded, partial or unsupported, for the packages of the contract, with a confidence.

    contract: package_id, minimum_sources, partial_results_allowed; results: package_id, state, confidence; complete: as of
    completeness; items: what the package has found (package_id); valid: as of validate_evidence; ambiguities, failures and
    issues: package_id. An ambiguity or an ambiguous result comes before all. An answer is supported by an item and as many
    sources as the contract asks for; supported, it is corpus_complete if the package is complete, grounded without failure,
    issue (too few sources and another generation are issues) or result that is partial, failed or unsupported, else partial
    where partial results are allowed. confidence is the mean of the results that are successful or partial, or 0.
    """
    flag = lambda df, name: df.select(P).distinct().withColumn(name, F.lit(True))
    count = lambda df, name: df.groupBy(P).agg(F.count(F.lit(1)).alias(name))
    own = results.groupBy(P).agg(
        F.some(F.col("state") == "ambiguous").alias("_ambiguous"), F.some(F.col("state").isin("partial", "failed", "unsupported")).alias("_degraded"),
        F.round(F.avg(F.when(F.col("state").isin("success", "partial"), F.col("confidence"))), 6).alias("_mean"),
    )
    joined = contract.select(P, "minimum_sources", "partial_results_allowed").join(own, P, "left").join(complete.select(P, F.col("state").alias("_complete"), "generation_mismatch"), P, "left")
    joined = joined.join(count(items, "_items"), P, "left").join(count(valid.select(P, "version_id", "chunk_id").distinct(), "_sources"), P, "left")
    for df, name in ((ambiguities, "_a"), (failures, "_f"), (issues, "_i")):
        joined = joined.join(flag(df, name), P, "left")
    sources = F.coalesce("_sources", F.lit(0))
    supported = (F.coalesce("_items", F.lit(0)) > 0) & (sources >= F.col("minimum_sources"))
    degraded = F.coalesce("_f", "_i", F.lit(False)) | F.coalesce("_degraded", F.lit(False)) | F.coalesce("generation_mismatch", F.lit(False))
    state = (
        F.when(F.coalesce("_a", F.lit(False)) | F.coalesce("_ambiguous", F.lit(False)), "ambiguous").when(~supported, "unsupported").when(F.col("_complete") == "complete", "corpus_complete")
        .when(~degraded, "grounded").when(F.col("partial_results_allowed"), "partial").otherwise("unsupported")
    )
    return joined.select(P, state.alias("state"), sources.alias("sources"), F.coalesce("_mean", F.lit(0.0)).alias("confidence"))


def audit_citations(messages: DataFrame, key: tuple[str, ...] = ("document_id", "chunk_id")) -> DataFrame:
    """Citation markers [n] of answers renumbered in order of first use, with the citations that stay.

    messages: message_id, content, citations (array of structs with the fields of `key`). Markers of one chunk become one citation, the first that
    is used. Returns content, citations, accepted: false if there is no marker or one is out of range; such content stays as
    it is and loses its citations.
    """
    marks = F.transform(F.regexp_extract_all("content", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    marked = messages.withColumn("_used", F.array_distinct(marks))
    ok = (F.size("_used") > 0) & ~F.exists("_used", lambda n: n.isNull() | (n < 1) | (n > F.size("citations")))
    judged = marked.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    same = lambda c: F.struct(*[F.coalesce(c[f].cast("string"), F.lit("")).alias(f) for f in key])
    keys = F.when(F.col("accepted"), F.transform("_used", lambda n: same(F.get("citations", n - 1))))
    numbered = judged.withColumn("_keys", keys).withColumn("_final", F.array_distinct("_keys"))
    place = lambda n: F.array_position("_final", F.get("_keys", (F.array_position("_used", n) - 1).cast("int")))
    parts = F.split("content", r"(?=\[\d+\])|(?<=\[\d{1,9}\])")
    renumber = lambda p: F.when(p.rlike(r"^\[\d+\]$"), F.concat(F.lit("["), place(F.regexp_extract(p, r"(\d+)", 1).try_cast("int")).cast("string"), F.lit("]"))).otherwise(p)
    content = F.when(F.col("accepted"), F.array_join(F.transform(parts, renumber), "")).otherwise(F.col("content"))
    first = F.transform("_final", lambda k: F.get("citations", F.get("_used", (F.array_position("_keys", k) - 1).cast("int")) - 1))
    kept = F.when(F.col("accepted"), first).otherwise(F.slice("citations", 1, 0))
    return numbered.select("message_id", content.alias("content"), kept.alias("citations"), "accepted")


def citation_summary(audited: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """Five counts of each audited answer: candidates of the retrieval, evidence that was selected, cited and shown, and selected without use.

    selections: message_id, input_count, selected_count; without, or where one is null, what was cited counts as selected
    and what was selected as candidates.
    """
    cited = F.size("citations").cast("long")
    joined = audited.join(selections, "message_id", "left") if selections is not None else audited.withColumns({"input_count": F.lit(None).cast("long"), "selected_count": F.lit(None).cast("long")})
    selected = F.coalesce(F.col("selected_count").cast("long"), cited)
    return joined.select(
        "message_id", F.coalesce(F.col("input_count").cast("long"), selected).alias("retrieval_candidate_count"), selected.alias("selected_evidence_count"), cited.alias("cited_evidence_count"),
        cited.alias("user_visible_source_count"), F.greatest(F.lit(0).cast("long"), selected - cited).alias("unused_selected_evidence_count"),
    )


def orphan_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(owner, ref): references (owner, refs array) to what was not collected (ids: id)."""
    return refs.select("owner", F.explode("refs").alias("ref")).distinct().join(ids.select(F.col("id").alias("ref")), "ref", "left_anti").select("owner", "ref")


def readable_source(refs: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame, logical: DataFrame) -> DataFrame:
    """Chunks with their document, version and, if there is one, section."""
    return refs.join(chunks, "chunk_id").join(documents, "document_id").join(versions, "version_id").join(logical, "logical_id", "left")
