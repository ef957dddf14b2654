"""Usage accounting, run states and conversations over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States after which a run no longer changes.
TERMINAL = ("completed", "failed", "cancelled", "interrupted")
#: Statuses of costs that count against a budget.
COUNTED = ("exact", "local_zero")
MILLION = 1_000_000


def price_usage(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of each usage event by a rate card (provider, model, input, cached, output, embedding: price of a million tokens).

    An event without a rate is unpriced and has no cost; absent token counts count as none. Reasoning tokens are part of
    the output; with a rate of their own (reasoning) they are priced by it, and the rest of the output by the output rate.
    """
    parts = ("input", "cached", "output", "embedding", "reasoning")
    card = rates.select("provider", "model", *[(F.col(c) if c in rates.columns else F.lit(None)).cast("decimal(14,8)").alias(f"_{c}") for c in parts], F.lit(True).alias("_known"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,0)") if c in events.columns else F.lit(0).cast("decimal(12,0)")
    fresh = F.greatest(n("input_tokens") - n("cached_input_tokens"), F.lit(0).cast("decimal(12,0)"))
    price = lambda tokens, rate: tokens * F.coalesce(F.col(rate), F.lit(0)) / F.lit(MILLION).cast("decimal(7,0)")
    thought = F.when(F.col("_reasoning").isNotNull(), F.least(n("reasoning_tokens"), n("output_tokens"))).otherwise(F.lit(0).cast("decimal(12,0)"))
    cost = price(fresh, "_input") + price(n("cached_input_tokens"), "_cached") + price(n("output_tokens") - thought, "_output") + price(thought, "_reasoning") + price(n("embedding_tokens"), "_embedding")
    joined = events.join(card, ["provider", "model"], "left")
    priced = joined.withColumn("cost_status", F.when(F.col("_known"), "priced").otherwise("unpriced")).withColumn("cost_amount", F.when(F.col("_known"), cost.cast("decimal(20,10)")))
    return priced.drop("_input", "_cached", "_output", "_embedding", "_reasoning", "_known")


def usage_totals(events: DataFrame, views: list[list[str]]) -> DataFrame:
    """Token and cost sums of several groupings at once; a cost only where every event is priced.

    views: lists of key columns. Returns the keys, view (its number), events, tokens, cost.
    """
    keys = list(dict.fromkeys(k for v in views for k in v))
    sets = [[F.col(k) for k in v] for v in views]
    grouped = events.groupingSets(sets, *keys).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("tokens"), F.every(F.col("cost_status") == "priced").alias("_all"), F.sum("cost_amount").alias("_cost"))
    number = F.lit(None).cast("int")
    for i, v in enumerate(views):
        mark = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in v)
        number = F.when(F.col("_g") == mark, i).otherwise(number)
    return grouped.select(*keys, number.alias("view"), "events", "tokens", F.when(F.col("_all"), F.col("_cost")).alias("cost"))


def stage_cost(reports: DataFrame) -> DataFrame:
    return reports.groupBy("workspace_id", "stage").agg(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("cost"))


def catalog_overview(documents: DataFrame, chunks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Counts of documents and chunks of each workspace, and with runs (workspace_id, state, at) its latest state; deleted documents don't count."""
    alive = documents.where("deleted_at is null")
    docs = alive.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("documents"))
    parts = chunks.join(alive.select("document_id"), "document_id", "left_semi").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("chunks"))
    counts = docs.join(parts, "workspace_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    if runs is None:
        return counts
    last = runs.groupBy("workspace_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    return counts.join(last, "workspace_id", "left")


def recent_documents(documents: DataFrame, n: int = 6) -> DataFrame:
    """The n documents that were changed last, ties by id."""
    return documents.where("deleted_at is null").orderBy(F.col("updated_at").desc_nulls_last(), "document_id").limit(n)


def runs_by_state(runs: DataFrame, by: list[str], states: list[str], state: str = "state") -> DataFrame:
    """A count for each state, side by side."""
    return runs.groupBy(*by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def daily_budget(events: DataFrame, amount: str, at: str, limit: float, by: list[str], status: str | None = None) -> DataFrame:
    """Spend a day and whether it has reached the soft limit (one of 0 or less is none).

    With a status column only exact and local_zero costs count, as estimates do not.
    """
    rows = events.where(F.col(status).isin(*COUNTED)) if status else events
    days = rows.groupBy(*by, F.to_date(at).alias("day")).agg(F.sum(amount).alias("spend"))
    return days.withColumn("over", (F.col("spend") >= limit) if limit > 0 else F.lit(False))


def nodes_per_generation(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("generation_id").agg(F.count(F.lit(1)).alias("nodes"))


def ingestion_report(logical: DataFrame, chunks: DataFrame, entities: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Of each source its sections, each with its count of chunks, in order; with entities (chunk_id, entity_id) and nodes
    (entity_id) also with the distinct entities of its chunks and how many of these are in the graph."""
    sizes = chunks.groupBy("logical_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined, levels = logical.join(sizes, "logical_id", "left"), ["n_chunks"]
    if entities is not None:
        found = chunks.select("logical_id", "chunk_id").join(entities.select("chunk_id", "entity_id"), "chunk_id").select("logical_id", "entity_id").distinct()
        known = nodes.select("entity_id").distinct().withColumn("_node", F.lit(1)) if nodes is not None else found.select("entity_id").limit(0).withColumn("_node", F.lit(1))
        counts = found.join(known, "entity_id", "left").groupBy("logical_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count("_node").alias("n_nodes"))
        joined, levels = joined.join(counts, "logical_id", "left"), [*levels, "n_entities", "n_nodes"]
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in levels})
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "logical_id", *levels)))
    return joined.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_sections"), *[F.sum(c).alias(c) for c in levels], parts.alias("sections"))


def memory_window(messages: DataFrame, n: int = 12, width: int = 500, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation, oldest first, cut to `width` characters."""
    ranked = messages.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("_r") <= n)
    count = F.count(F.lit(1)).over(W.partitionBy(by))
    return ranked.select(by, (count - F.col("_r") + 1).cast("int").alias("position"), "role", F.substring("text", 1, width).alias("text"))


def conversation_titles(messages: DataFrame, width: int = 72, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The first user message, blanks collapsed, at most `width` characters with an ellipsis."""
    first = messages.where("role = 'user'").groupBy(by).agg(F.min_by("text", order).alias("t"))
    line = F.trim(F.regexp_replace("t", r"[ \t\n\x0B\f\r]+", " "))
    return first.select(by, F.when(F.length(line) > width, F.concat(F.rtrim(F.substring(line, 1, width - 1)), F.lit("…"))).otherwise(line).alias("title"))


def carry_focus(turns: DataFrame, by: str = "conv_id", order: str = "turn", kind: str = "entity_type", entity: str = "entity_id", keep: int = 20, period: str | None = None, periods: int = 10) -> DataFrame:
    """Turns with the focus that they have, and the conversation's state after each: `recent`, the last `keep` distinct
    entities, and `periods`, the last `periods` that were named; both oldest first, strings.

    A turn's focus is its entity or, where it has none, the last of its type in the state, of any type for `unknown`. A focus,
    named or inherited, moves to the end of the state. With a period column a turn's period is added as it is, repeats too.
    Conversations are dealt by id and streamed in order, with a state of bounded size, so a long one needs no more memory.
    """
    cast = [F.col(c).cast("string").alias(a) for c, a in ((kind, "_kind"), (entity, "_entity"))]
    named = turns.select("*", *cast, (F.col(period).cast("string") if period else F.lit(None).cast("string")).alias("_period"))
    sorted_rows = named.repartition(by).sortWithinPartitions(by, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, last = None, {}, []
        for batch in batches:
            focus, recent, named = [], [], []
            for key, what, who, when in zip(batch[by], batch["_kind"], batch["_entity"], batch["_period"]):
                key = None if pd.isna(key) else key
                if (key,) != held:
                    held, state, last = (key,), {}, []
                if who is None:
                    who = next((e for e, k in reversed(state.items()) if what == "unknown" or k == what), None)
                    what = state.get(who, what)
                if who is not None:
                    state.pop(who, None)  # an entity is there once, where it was named last
                    state[who] = what
                    if len(state) > keep:
                        del state[next(iter(state))]
                if when is not None:
                    last = [*last, when][-periods:]
                focus.append(who)
                recent.append(list(state))
                named.append(list(last))
            yield batch.drop(columns=["_kind", "_entity", "_period"]).assign(focus=focus, recent=recent, periods=named)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    out = sorted_rows.mapInPandas(fold, f"{schema}, focus string, recent array<string>, periods array<string>")
    return out if period else out.drop("periods")


#: Phrasings of question kinds, of Turkish and English questions, in the order they are tried.
_B = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"
LOOKUP = r"hangi\s+(?:belge|dosya)|(?:belge|dosya)lerde\s+geç|(?:ge[çc]ti[ğg]i|bulundu[ğg]u|ad[ıi]\s+ge[çc]en)\s+(?:belge|dosya)ler|ge[çc]en\s+(?:belge|dosya)leri\s+listele|(?:belge|dosya)lerini\s+listele|appears?\s+in\s+which\s+documents?|documents?\s+(?:containing|mentioning)"
PROPERTY_TERMS = _B + r"(?:mal|mülk|taşınmaz|gayrimenkul|tapu|parsel|arsa|arazi|daire|büro|işyeri|hisse|hissedar|mulk|tasinmaz|is yeri)"
COUNT = r"(?:kaç|kac)\s+(?:adet|tane|farklı)|how many"
INVENTORY = r"(?:hangi|tüm|tum)\s+(?:mal|mülk|mulk|taşınmaz|tasinmaz|gayrimenkul|parsel)|(?:malları|mallari|mülkleri|mulkleri|taşınmazları|tasinmazları|gayrimenkulleri)\s+(?:var|nelerdir)|(?:mal|mülk|mulk|taşınmaz|tasinmaz|gayrimenkul|parsel)[\p{L}\p{N}_]*.{0,40}(?:listele|grupla)"
YEAR = _B + r"(1[0-9]{3}|20[0-9]{2})(?:\s*(?:yılında|de|da))?" + _E
IDENTIFY = _B + r"kim(?:dir)?" + _E + r"|who is"
DESCRIBE = r"hakkında|ilgili bilgi ver|neler biliyoruz|tell me about|what do we know"
SUFFIXES = (
    r"kim(?:dir)?",
    r"hakkında\s+(?:neler|ne)\s+biliyoruz",
    r"hakkında",
    r"hangi\s+(?:belgelerde|dosyalarda)\s+geç(?:iyor|mektedir)?",
    r"(?:hangi|tüm)\s+(?:malları|gayrimenkulleri)\s+(?:var|nelerdir)",
    r"kaç\s+adet\s+(?:tapusu|gayrimenkulü)\s+var",
    r"ile\s+ilgili\s+ne\s+olmuş",
)
GENITIVE = r"(?iu)(?:['’](?:in|ın|un|ün)|['’]?(?:nin|nın|nun|nün))\s+.*$"


def tag_queries(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What each question asks for: operation, flags, mention and years.

    Kinds are tried in order: document lookup, count of property, inventory, timeline, identity, description, other.
    """
    low = F.lower(F.col(text_col))
    property_ = low.rlike(PROPERTY_TERMS)
    operation = (
        F.when(low.rlike(LOOKUP), "lookup_documents")
        .when(low.rlike(COUNT) & property_, "count")
        .when(low.rlike(INVENTORY), "list")
        .when(low.rlike(YEAR), "timeline")
        .when(low.rlike(IDENTIFY), "identify")
        .when(low.rlike(DESCRIBE), "describe")
        .otherwise("generic_qa")
    )
    tagged = messages.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query"), F.coalesce(operation, F.lit("generic_qa")).alias("operation"))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("query", F.lit("")), r"^[\s?!.]+|[\s?!.]+$", ""), r"\s+", " ")
    owned = F.when(F.col("operation").isin("list", "count"), F.regexp_replace(plain, GENITIVE, "")).otherwise(plain)
    when = F.regexp_replace(owned, r"(?iu)^\s*(?:1[0-9]{3}|20[0-9]{2})(?:['’]?(?:de|da|te|ta))?\s+(?:yılında\s+)?", "")
    name = F.regexp_replace(F.regexp_replace(when, rf"(?iu)\s*(?:{'|'.join(SUFFIXES)})\s*$", ""), r"^[\s?!.'’]+|[\s?!.'’]+$", "")
    from marginalia.functions.text import year_range

    exhaustive = F.col("operation").isin("count", "list")
    years = year_range(F.coalesce("query", F.lit("")))
    return tagged.select("query_id", "operation", exhaustive.alias("exhaustive"), F.when((F.length(name) > 0) & (F.length(name) <= 120), name).alias("mention"), years.getField("start").alias("date_start"), years.getField("end").alias("date_end"))


def expand_queries(plans: DataFrame) -> DataFrame:
    """(query_id, turn, text): the question, its resolved name and its mention, each once. plans: query_id, query, resolved, mention."""
    texts = F.array_distinct(F.array_compact(F.array("query", "resolved", "mention")))
    return plans.select("query_id", F.posexplode(texts).alias("turn", "text"))


def run_states(events: DataFrame, stale_before: Column | None = None) -> DataFrame:
    """The latest state of each run; a run that has been running since before a time counts as interrupted. events: run_id, state, at."""
    last = events.groupBy("run_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))
    if stale_before is None:
        return last
    return last.withColumn("state", F.when((F.col("state") == "running") & (F.col("at") < stale_before), "interrupted").otherwise(F.col("state")))
