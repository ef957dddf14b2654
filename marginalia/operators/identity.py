"""Replay of identity operations: which entity each one lives on in, as of any operation, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.session import materialize

POINTER = ["id", "up", "seq"]


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast: a replay has some hundred joins, and a broadcast goes through the driver."""
    return df.hint("merge")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def follow(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, closing) of pointers (id, up, seq), one for each id.

    roots has (id, root, latest): where an id's pointers end, and the greatest seq on the way. closing has (id, seq) of the
    pointer with the greatest seq of each cycle; what leads into a cycle has no root. Pointers double in each round, and only
    those that have not ended go on, so that the rounds are the logarithm of the longest way.
    """
    ids = pointers.select(F.col("id").alias("up"), F.lit(True).alias("goes_on"))
    start = materialize(pointers.join(_dealt(ids), "up", "left").select("id", F.col("up").alias("at"), F.col("seq").alias("latest"), F.col("goes_on").isNull().alias("ended")))
    ended, going, steps = [start.where("ended")], start.where("NOT ended"), 1
    left = going.count()
    while left:
        known = _stacked([*ended, going]).select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("latest").alias("later"), F.col("ended").alias("over"))
        moved = materialize(going.join(_dealt(known), "at").select("id", F.col("further").alias("at"), F.greatest("latest", "later").alias("latest"), F.col("over").alias("ended")))
        ended.append(moved.where("ended"))
        going, steps, before = moved.where("NOT ended"), 2 * steps, left
        left = going.count()
        if left == before and steps >= left:
            break  # a way without a cycle would have ended
    roots = _stacked(ended).select("id", F.col("at").alias("root"), "latest")
    cycles = going.join(_dealt(going.select(F.col("at").alias("id")).distinct()), "id", "left_semi").select("id", F.col("latest").alias("seq"))
    return roots, cycles.join(_dealt(pointers.select("id", "seq")), ["id", "seq"], "left_semi")


def _first(ops: DataFrame) -> DataFrame:
    return ops.groupBy("id").agg(F.min(F.struct("seq", "up")).alias("op")).select("id", "op.up", "op.seq")


def surviving_pointers(ops: DataFrame) -> DataFrame:
    """The pointers (id, up, seq) that merges (id, up, seq; seq unique) leave when they are applied in order of seq.

    An entity ends once, with the first of its merges that does not lead back to it. So each entity takes its first merge;
    of each cycle the last merge is the one that would have led back, so it falls away and its entity takes its next merge
    that, at its time, led elsewhere. This goes on until no cycle is left.
    """
    pointers = materialize(_first(ops))
    while True:
        roots, closing = follow(pointers)
        closing = materialize(closing)
        if closing.isEmpty():
            return pointers
        kept = materialize(pointers.join(_dealt(closing), ["id", "seq"], "left_anti").select(*POINTER))
        roots, _ = follow(kept)
        later = ops.join(_dealt(closing.select("id", F.col("seq").alias("closed"))), "id").where("seq > closed")
        ends = roots.select(F.col("id").alias("up"), "root", "latest")
        back = (F.col("up") == F.col("id")) | (F.coalesce(F.col("root") == F.col("id"), F.lit(False)) & (F.col("latest") < F.col("seq")))
        pointers = materialize(kept.unionByName(_first(later.join(_dealt(ends), "up", "left").where(~back).select(*POINTER))))


def living_at(asked: DataFrame, pointers: DataFrame) -> DataFrame:
    """`asked` (id, before, ...) with `living`: where the id had been merged to by operations of a seq less than `before`.

    Ways of 1, 2, 4, ... pointers with the greatest seq on them are written once, and the asked go up by the longest first.
    """
    ways = [materialize(pointers.select("id", "up", F.col("seq").alias("latest")))]
    while not ways[-1].isEmpty():
        last = ways[-1]
        upper = last.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("latest").alias("later"))
        ways.append(materialize(last.join(_dealt(upper), "up").select("id", F.col("further").alias("up"), F.greatest("latest", "later").alias("latest"))))
    found = asked.withColumn("living", F.col("id"))
    for way in reversed(ways[:-1]):
        up = way.select(F.col("id").alias("living"), F.col("up").alias("up_"), F.col("latest").alias("latest_"))
        found = found.join(_dealt(up), "living", "left").withColumn("living", F.when(F.col("latest_") < F.col("before"), F.col("up_")).otherwise(F.col("living"))).drop("up_", "latest_")
    return found


def replay_merges(entities: DataFrame, merges: DataFrame, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(survivors, operations) of merges (seq, source_id, target_id) applied in order of seq, up to that of `as_of`.

    entities: entity_id, entity_type. survivors: entity_id, survivor_id, superseded_by_seq, for each entity once. operations:
    seq, source_id, target_id, applied, reason, survivor_id (the living entity that the target stood for then, where the merge
    is applied). A merge into a superseded entity is one into the entity that lives on for it. Not applied, with the reason,
    are merges of or into an entity that is not there (missing), across types (type), of a superseded entity (superseded),
    and of an entity into itself or what lives on as itself (same). seq is unique; rows with a null seq are not merges.
    """
    held = merges.where("seq IS NOT NULL" if as_of is None else F.col("seq") <= as_of).select("seq", "source_id", "target_id")
    kinds = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("entity_type").alias(f"{side}_type"), F.lit(True).alias(f"{side}_there")).dropDuplicates([f"{side}_id"])
    judged = held.join(_dealt(kinds("source")), "source_id", "left").join(_dealt(kinds("target")), "target_id", "left")
    there = F.col("source_there").isNotNull() & F.col("target_there").isNotNull()
    judged = materialize(judged.select("seq", "source_id", "target_id", F.when(~there, "missing").when(~F.col("source_type").eqNullSafe(F.col("target_type")), "type").when(F.col("source_id") == F.col("target_id"), "same").alias("refused")))
    ops = judged.where("refused IS NULL").select(F.col("source_id").alias("id"), F.col("target_id").alias("up"), "seq")
    pointers = surviving_pointers(ops)
    roots, _ = follow(pointers)
    ended = pointers.select(F.col("id").alias("entity_id"), F.col("seq").alias("superseded_by_seq"))
    survivors = entities.select("entity_id").distinct().join(_dealt(roots.select(F.col("id").alias("entity_id"), "root")), "entity_id", "left").join(_dealt(ended), "entity_id", "left")
    done = judged.join(_dealt(pointers.select(F.col("id").alias("source_id"), F.col("seq").alias("done"))), "source_id", "left")
    reason = F.coalesce("refused", F.when(F.col("seq") > F.col("done"), "superseded").when(F.col("seq") == F.col("done"), None).otherwise("same"))
    done = done.select("seq", "source_id", F.col("target_id").alias("id"), F.col("seq").alias("before"), reason.alias("reason"))
    living = living_at(done, pointers)
    operations = living.select("seq", "source_id", F.col("id").alias("target_id"), F.col("reason").isNull().alias("applied"), "reason", F.when(F.col("reason").isNull(), F.col("living")).alias("survivor_id"))
    return survivors.select("entity_id", F.coalesce("root", "entity_id").alias("survivor_id"), "superseded_by_seq"), operations


def merge_entities(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, merges: DataFrame, as_of: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, mentions, operations) after merges (seq, source_id, target_id), or as of one of them.

    Each entity stays one row; merged ones are superseded, and their aliases and mentions are at the one that lives on; see
    replay_merges for what is not applied. Aliases that meet are one.
    """
    survivors, operations = replay_merges(entities, merges, as_of)
    survivors = materialize(survivors)
    gone = survivors.where("superseded_by_seq IS NOT NULL").select(F.col("entity_id").alias("_from"), F.col("survivor_id").alias("_to"))
    move = lambda df: df.join(_dealt(gone), df["entity_id"] == F.col("_from"), "left").withColumn("entity_id", F.coalesce("_to", "entity_id")).drop("_from", "_to")
    marked = entities.join(_dealt(gone), entities["entity_id"] == F.col("_from"), "left").withColumn("status", F.when(F.col("_from").isNotNull(), "superseded").otherwise(F.col("status"))).drop("_from", "_to")
    return marked, move(aliases).distinct(), move(mentions), operations


def merge_history(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(entity_id, seq, role, other_id, applied, status): each operation of an entity, and whether it lived on after it.

    The role is source or target; other_id is what the entity was merged into (the survivor) or what was merged into it. An
    entity that lived on for a target has the operation too, as survivor.
    """
    survivors, operations = replay_merges(entities, merges)
    operations = materialize(operations)
    side = lambda role, own, other: operations.select(F.col(own).alias("entity_id"), "seq", F.lit(role).alias("role"), F.col(other).alias("other_id"), "applied")
    heir = operations.where("applied AND survivor_id <> target_id")
    rows = side("source", "source_id", "survivor_id").unionByName(side("target", "target_id", "source_id")).unionByName(heir.select(F.col("survivor_id").alias("entity_id"), "seq", F.lit("survivor").alias("role"), F.col("source_id").alias("other_id"), "applied"))
    ended = survivors.select("entity_id", "superseded_by_seq")
    status = F.when(F.col("superseded_by_seq") <= F.col("seq"), "superseded").otherwise("active")
    return rows.join(_dealt(ended), "entity_id").select("entity_id", "seq", "role", "other_id", "applied", status.alias("status"))
