"""Corpus preparation: sections, chunks, versions, duplicates, fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.relational import first_seen

CHUNK_WORDS, CHUNK_OVERLAP = 500, 50
PARAGRAPH_END = re.compile(r"\n\s*\n")


def split_logical(docs: DataFrame) -> DataFrame:
    """Sections of documents (doc_id, text) at level-2 headings; a document without one is one section.

    Returns doc_id, ordinal (from 0), title (without a heading the file's name without its ending, from source_original if that
    column is there), content. Deeper headings stay inside their section;
    text before the first heading is no section. Lines are numbered and grouped within a document, in expressions: one
    row a document goes in, its sections come out, without a shuffle.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=##[ \t]+\S)")
    file = F.regexp_extract("source_original", r"([^/]*)/*$", 1) if "source_original" in docs.columns else F.lit(None).cast("string")
    stem = F.coalesce(F.nullif(F.regexp_extract(file, r"^(.+)\.[^.]+$", 1), F.lit("")), file)
    numbered = docs.select("doc_id", F.posexplode(parts).alias("at", "part"), (F.size(parts) > 1).alias("cut"), stem.alias("stem"))
    kept = numbered.where((F.col("at") > 0) | ~F.col("cut"))
    title = F.when(F.col("cut"), F.trim(F.regexp_extract("part", r"^##[ \t]+([^\n]*)", 1))).otherwise(F.col("stem"))
    return kept.select("doc_id", F.when(F.col("cut"), F.col("at") - 1).otherwise(0).alias("ordinal"), title.alias("title"), F.trim(F.regexp_replace("part", r"^\n", "")).alias("content"))


def section_pages(sections: DataFrame) -> DataFrame:
    """page_end of each section: the page before the next one's, at least its own first; where no next page is known
    the document's total_pages, if that column is there and known, else its own. Without page_start there is none."""
    following = F.lead("page_start").over(W.partitionBy("doc_id").orderBy("ordinal"))
    total = F.col("total_pages") if "total_pages" in sections.columns else F.lit(None).cast("long")
    end = F.when(following.isNotNull(), F.greatest("page_start", following - 1)).otherwise(F.coalesce(total, "page_start"))
    return sections.withColumn("page_end", F.when(F.col("page_start").isNotNull(), end))


def tag_type(sections: DataFrame, rules: list[tuple[str, list[str]]], default: str = "document") -> DataFrame:
    """The first rule (type, keywords) of which a keyword is in the title or the first 500 characters."""
    head = F.lower(F.concat_ws(" ", "title", F.substring("content", 1, 500)))
    tag = F.lit(None).cast("string")
    for kind, words in reversed(rules):
        held = F.lit(False)
        for word in words:
            held = held | F.contains(head, F.lit(word.lower()))
        tag = F.when(held, kind).otherwise(tag)
    return sections.withColumn("document_type", F.coalesce(tag, F.lit(default)))


def _paragraphs(text: str) -> Iterator[tuple[str | None, list[str]]]:
    """The words of each paragraph with the heading that it stands under; a heading's line is no text."""
    heading = None
    for paragraph in PARAGRAPH_END.split(text.strip()):
        line, _, rest = paragraph.partition("\n")
        if line.startswith("#"):
            heading, paragraph = line.lstrip("#").strip() or None, rest
        if words := paragraph.split():
            yield heading, words


def _pack(text: str, limit: int, overlap: int) -> Iterator[tuple[str, str | None]]:
    """Passages of paragraphs in turn, each with the last heading that it has; a paragraph that does not fit begins one with
    the last `overlap` words, and one of over `limit` words is cut, each piece after the words that it repeats."""
    held: list[str] = []
    under = None
    tail = lambda words: words[len(words) - overlap :] if overlap < len(words) else words if overlap else []
    for heading, words in _paragraphs(text):
        if held and len(held) + len(words) > limit:
            yield " ".join(held), under
            held = tail(held)
        under = heading or under
        while len(words) > limit:
            room = limit - len(held)
            full, words = held + words[:room], words[room:]
            yield " ".join(full), under
            held = tail(full)
        held = held + words
    if held:
        yield " ".join(held), under


def chunk_corpus(sections: DataFrame, limit: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of sections (doc_id, content): paragraphs packed up to `limit` words, with the `overlap` last words of the one before.

    A paragraph that fits by itself is not cut, so a chunk may have `limit` + `overlap` words. Lines of headings are in no chunk.

    Packing is sequential within a section only, so sections are packed where they lie. Returns doc_id, ordinal, heading,
    content. A section of no words has no chunk.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, h, c) for d, t in zip(batch["doc_id"], batch["content"]) for i, (c, h) in enumerate(_pack(t or "", limit, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "heading", "content"])

    return sections.select("doc_id", "content").mapInPandas(packed, "doc_id long, ordinal int, heading string, content string")


def chunk_stride(docs: DataFrame, limit: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of `limit` words that begin every limit - overlap words, in expressions only."""
    words = docs.select("doc_id", F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("words"))
    step = limit - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.lit(overlap) - 1), F.lit(step))
    spread = words.where(F.size("words") > 0).select("doc_id", "words", F.posexplode(starts).alias("ordinal", "start"))
    return spread.select("doc_id", "ordinal", F.array_join(F.slice("words", F.col("start") + 1, limit), " ").alias("content"))


def dedupe_sources(new: DataFrame, versions: DataFrame, workspace: str = "workspace_id", source_hash: str = "source_hash", tie: str = "doc_id") -> DataFrame:
    """New sources whose hash the workspace lacks; of equal new ones the first stays."""
    fresh = new.join(versions.select(workspace, source_hash).distinct(), [workspace, source_hash], "left_anti")
    return first_seen(fresh, [workspace, source_hash], [tie])


def assign_versions(new: DataFrame, versions: DataFrame, key: str = "document_id", tie: str = "source_hash") -> DataFrame:
    """new with version_number: on from the highest of each document."""
    last = versions.groupBy(key).agg(F.max("version_number").alias("_last"))
    turn = F.row_number().over(W.partitionBy(key).orderBy(tie))
    return new.join(last, key, "left").withColumn("version_number", turn + F.coalesce("_last", F.lit(0))).drop("_last")


def apply_versions(new: DataFrame, documents: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions with the new ones, documents that point to their newest version).

    Versions: version_id, document_id, version_number, source_hash; new: document_id, version_id, source_hash.
    """
    numbered = assign_versions(new, versions)
    every = versions.unionByName(numbered.select(*versions.columns))
    newest = numbered.groupBy("document_id").agg(F.max_by("version_id", "version_number").alias("_newest"))
    moved = documents.join(newest, "document_id", "left").withColumn("active_version_id", F.coalesce("_newest", "active_version_id")).drop("_newest")
    return every, moved


def link_chunks(chunks: DataFrame, by: list[str], order: str = "ordinal", chunk: str = "chunk_id") -> DataFrame:
    """(source, target, kind next) of neighbouring chunks."""
    following = F.lead(chunk).over(W.partitionBy(*by).orderBy(order))
    links = chunks.select(*by, F.col(chunk).alias("source_chunk_id"), following.alias("target_chunk_id"))
    return links.where("target_chunk_id is not null").withColumn("kind", F.lit("next"))


def effective_metadata(rows: DataFrame, by: list[str], key: str = "key", value: str = "value", origin: str = "origin", order: str = "updated_at") -> DataFrame:
    """One value for each key: user before extracted before system, later before earlier."""
    rank = F.when(F.col(origin) == "user", 3).when(F.col(origin) == "extracted", 2).when(F.col(origin) == "system", 1).otherwise(0)
    return rows.groupBy(*by, key).agg(F.max_by(value, F.struct(rank, order, value)).alias(value))


def _set_fingerprint(hashes: DataFrame, by: list[str], column: str) -> DataFrame:
    """A digest of the set of hashes of each group, in two levels: no task holds all hashes of a group, only 4096 digests."""
    slot = F.conv(F.substring(column, 1, 3), 16, 10).cast("int")
    low = hashes.groupBy(*by, slot.alias("_slot"), F.substring(column, 1, 6).alias("_piece")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias("_h"))
    mid = low.groupBy(*by, "_slot").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("_h"))
    return mid.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("fingerprint"))


def corpus_fingerprint(docs: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """One digest a workspace that changes with any row or field; order and partitioning don't matter."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]), 256)
    return _set_fingerprint(docs.select(*by, row.alias("_row")), by, "_row")


def stage_fingerprint(table: DataFrame, stage: str, generation: str) -> DataFrame:
    """(stage, fingerprint): what a stage of a generation put out, as its name and a digest of the generation and all rows."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in sorted(table.columns)]), 256)
    whole = _set_fingerprint(table.select(row.alias("_row")), [], "_row")
    digest = F.sha2(F.concat(F.lit(f"{generation}:"), F.col("fingerprint")), 256)
    return whole.select(F.lit(stage).alias("stage"), F.concat(F.lit(f"{stage}:"), digest).alias("fingerprint"))


def curation_fingerprint(entities: DataFrame, aliases: DataFrame, operations: DataFrame) -> DataFrame:
    """The same for three tables at once, each under its kind: one row."""
    rows = None
    for kind, table in (("entity", entities), ("alias", aliases), ("operation", operations)):
        one = table.select(F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(table.columns)]), 256).alias("_row"))
        rows = one if rows is None else rows.unionByName(one)
    return _set_fingerprint(rows, [], "_row")


def plan_reindex(states: DataFrame, config_hash: Column) -> DataFrame:
    """What each workspace's index needs, and why. states: workspace_id, built_at, corpus_changed_at, config_hash, state."""
    reason = (
        F.when(F.col("built_at").isNull(), "never_built")
        .when(~F.col("config_hash").eqNullSafe(config_hash), "config_changed")
        .when(~F.col("state").eqNullSafe(F.lit("ready")), F.coalesce("state", F.lit("unknown")))
        .when(F.col("corpus_changed_at") > F.col("built_at"), "corpus_changed")
    )
    return states.select("workspace_id", F.when(reason.isNull(), "none").otherwise("full").alias("action"), F.coalesce(reason, F.lit("current")).alias("reason"))


#: Grams of which the least hash is taken as a fingerprint: a run of n words has as many grams of n - WINDOW + 1 words.
WINDOW = 5


def _words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("w"))


def fingerprints(words: DataFrame, n: int) -> DataFrame:
    """(id, gram, at): of each WINDOW grams in a row of a text's words the one of the least hash, the first of several.

    Two texts that share n words in a row share the fingerprint of that window, so what they share by chance or by
    fingerprint alone is for the caller to tell.
    """
    size = n - WINDOW + 1
    long = words.where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.xxhash64(F.slice("w", i, size)))
    hashed = long.select("id", grams.alias("g"))
    least = lambda i: F.slice("g", i, WINDOW)
    places = F.transform(F.sequence(F.lit(1), F.size("g") - (WINDOW - 1)), lambda i: (F.array_position(least(i), F.array_min(least(i))) + i - 2).cast("int"))
    chosen = hashed.select("id", "g", F.explode(F.array_distinct(places)).alias("at"))
    return chosen.select("id", F.get("g", F.col("at")).alias("gram"), "at")


def verbatim_runs(answers: DataFrame, sources: DataFrame, n: int = 12, answer_id: str = "item_id", source_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(answer, source, answer_start, source_start, length): every maximal run of n or more words that an answer shares with a source.

    Words are runs of letters, digits and underscores, in lower case, and are counted from 0. Fingerprints find pairs and
    diagonals (source place less answer place); on each the words themselves are compared, so no hash is taken on trust. Only
    the sources' fingerprints that an answer has are joined, and a pair's words meet once. n is at least WINDOW. Texts of
    fewer words than n have no run.
    """
    if n < WINDOW:
        raise ValueError(f"runs have at least {WINDOW} words")
    a, s = _words_of(answers, answer_id, text), _words_of(sources, source_id, text)
    here, there = fingerprints(a, n), fingerprints(s, n)
    pairs = here.select(F.col("id").alias("answer"), "gram", F.col("at").alias("x")).join(there.select(F.col("id").alias("source"), "gram", F.col("at").alias("y")), "gram")
    pairs = pairs.groupBy("answer", "source").agg(F.collect_set(F.col("y") - F.col("x")).alias("diagonals"))  # as many as the texts have words, at most
    held = pairs.join(a.select(F.col("id").alias("answer"), F.col("w").alias("a")), "answer").join(s.select(F.col("id").alias("source"), F.col("w").alias("s")), "source")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for answer, source, diagonals, left, right in zip(batch["answer"], batch["source"], batch["diagonals"], batch["a"], batch["s"]):
                for d in diagonals:
                    first, stop = max(0, -d), min(len(left), len(right) - d)
                    same = np.concatenate([[False], left[first:stop] == right[first + d : stop + d], [False]])
                    edges = np.flatnonzero(same[1:] != same[:-1])
                    for begin, end in zip(edges[::2], edges[1::2]):
                        if end - begin >= n:
                            out.append((answer, source, first + begin, first + begin + d, end - begin))
            yield pd.DataFrame(out, columns=["answer", "source", "answer_start", "source_start", "length"])

    kinds = [df.schema["id"].dataType.simpleString() for df in (a, s)]
    return held.select("answer", "source", "diagonals", "a", "s").mapInPandas(runs, f"answer {kinds[0]}, source {kinds[1]}, answer_start int, source_start int, length int")


def verbatim_overlap(answers: DataFrame, sources: DataFrame, n: int = 12, answer_id: str = "item_id", source_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(answer, source, shared, longest): pairs that share a run of n words, how many runs they share and the longest."""
    return verbatim_runs(answers, sources, n, answer_id, source_id, text).groupBy("answer", "source").agg(F.count(F.lit(1)).alias("shared"), F.max("length").alias("longest"))


def reassemble(sections: DataFrame, by: str = "doc_id", order: str = "ordinal", content: str = "content") -> DataFrame:
    """A document's text from its ordered sections."""
    parts = F.sort_array(F.collect_list(F.struct(order, content)))
    return sections.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p.getField(content)), "\n").alias("text"))


def embed_corpus(df: DataFrame, embed, id_col: str, text_col: str, dimension: int, batch: int = 64) -> DataFrame:
    """(id, embedding) by a user's function from texts to vectors.

    A batch that fails is halved until one text fails by itself, which fails the job. Vectors must have the dimension and
    be finite.
    """

    def of(texts: list[str]) -> list[list[float]]:
        try:
            return [list(map(float, v)) for v in embed(texts)]
        except Exception:
            if len(texts) == 1:
                raise
            return of(texts[: len(texts) // 2]) + of(texts[len(texts) // 2 :])

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                vectors = of(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimension or not all(abs(x) < float("inf") for x in v) for v in vectors):
                    raise ValueError("embeddings have another length, dimension or are not finite")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": vectors})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(embedded, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")
