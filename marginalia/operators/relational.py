"""Relational algebra over records: filters, joins, groups, ranks and set comparisons.

Null semantics, decided once: equality is null-safe (null equals null, differs from all else), also as a join key;
an ordering comparison with a null or unlike value is false; text tests on null are false; aggregates skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.sources.session import materialize

#: Rows of a key that are paired at once, on each side; a task pairs about the square of it.
PAIR_BLOCK = 4096
#: The most tasks that pairs are dealt to by their number.
PAIR_TASKS = 20_000
#: Members of a class in a row, on either side: the join holds what a row of the left meets in a block, as arrays.
PAIR_PIECE = 64
#: Members of the right in a row whose pairs are made: Spark holds all pairs of a row before it hands on the first.
PAIR_SHORT = 16


def _pieces(members: str, most: int) -> Column:
    """An array's members in arrays of `most` at most."""
    return F.transform(F.sequence(F.lit(1), F.size(members), F.lit(most)), lambda at: F.slice(members, at, most))


def paired_classes(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Rows of equal keys as pairs of classes, dealt evenly: what all pairs of members are made of by two explodes.

    A class has the rows of a side that differ in their id alone, as short arrays in the column of the id; keys that have more
    than `block` rows are cut to blocks by a hash of the id, and every block of the left meets every one of the right, each
    once. What holds for a pair of classes is computed once, before the explodes of paired_members(), and no pair of members is
    shuffled. The number of tasks follows the number of pairs. The other columns of both sides must have different names; null
    keys meet nothing, and rows without an id are left out.
    """
    left, right = materialize(left.where(F.col(left_id).isNotNull())), materialize(right.where(F.col(right_id).isNotNull()))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = materialize(count(left, "_nl").join(count(right, "_nr"), keys))
    pairs = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0.0
    tasks = left.sparkSession.sparkContext.defaultParallelism + min(PAIR_TASKS, int(pairs // block**2))

    def side(df: DataFrame, own_id: str, own: str, other: str) -> DataFrame:
        cuts = sizes.select(*keys, F.ceil(F.col(f"_n{own}") / block).alias("_own"), F.ceil(F.col(f"_n{other}") / block).alias("_other"))
        dealt = df.join(cuts, keys).withColumn(f"_{own}", F.pmod(F.xxhash64(own_id), "_own"))
        rest = [c for c in df.columns if c not in (*keys, own_id)]
        classes = dealt.groupBy(*keys, *rest, f"_{own}", "_other").agg(F.collect_list(own_id).alias(own_id))
        copied = classes.withColumn(own_id, F.explode(_pieces(own_id, PAIR_PIECE))).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1))).drop("_other")
        return copied.repartition(tasks, *keys, "_l", "_r")

    return side(left, left_id, "l", "r").join(side(right, right_id, "r", "l").hint("shuffle_hash"), [*keys, "_l", "_r"]).drop("_l", "_r")


def short_classes(classes: DataFrame, right_id: str) -> DataFrame:
    """Pairs of classes with the right in short pieces: cut after the join, which so ends before the pairs of members are made."""
    return classes.withColumn(right_id, F.explode(_pieces(right_id, PAIR_SHORT)))


def paired_members(classes: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The pairs of members of paired_classes(), each once, with what the pair of their classes has."""
    return short_classes(classes, right_id).withColumn(right_id, F.explode(right_id)).withColumn(left_id, F.explode(left_id))


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fields by new name: {name: field}."""
    return df.select(*[F.col(field).alias(name) for name, field in names.items()])


def compare(field: Column, op: str, value=None) -> Column:
    """A test that is true or false, never null. op: eq, not_eq, lt, lte, gt, gte, in, contains, starts_with, exists."""
    other = value if isinstance(value, Column) else None if isinstance(value, (list, tuple, set)) else F.lit(value)
    text = lambda x: F.lower(x.cast("string"))
    if op == "exists":
        return field.isNotNull()
    if op == "eq":
        return field.eqNullSafe(other)
    if op == "not_eq":
        return ~field.eqNullSafe(other)
    if op == "in":
        if other is not None:
            return F.lit(False)
        found = F.coalesce(field.isin([v for v in value if v is not None]), F.lit(False))
        return found | field.isNull() if any(v is None for v in value) else found
    if op == "contains":
        return F.coalesce(F.contains(text(field), text(other)), F.lit(False))
    if op == "starts_with":
        return F.coalesce(F.startswith(text(field), text(other)), F.lit(False))
    tests = {"lt": field < other, "lte": field <= other, "gt": field > other, "gte": field >= other}
    if op not in tests:
        raise ValueError(f"no comparison {op!r}")
    return F.coalesce(tests[op], F.lit(False))


def where_cmp(df: DataFrame, field: str, op: str, value=None) -> DataFrame:
    return df.where(compare(F.col(field), op, value))


def temporal_filter(df: DataFrame, start: str, end: str | None, ranges: list[tuple[str, str]]) -> DataFrame:
    """Records whose range [start, end] lies in every given range; times are ISO text and an absent end is the start."""
    last = F.coalesce(F.col(end), F.col(start)) if end else F.col(start)
    held = F.lit(True)
    for low, high in ranges:
        held = held & compare(F.col(start), "gte", low) & compare(last, "lte", high)
    return df.where(held)


def temporal_relative(df: DataFrame, time: str, anchors: DataFrame, anchor_time: str, side: str, on: list[str] | None = None) -> DataFrame:
    """Records before or after an anchor's time.

    With `on`, each record is compared with the anchors of its own key: before the latest of them or after the earliest.
    Without it, with all anchors alike; these bounds are one row, which is broadcast.
    """
    at = F.max(anchor_time) if side == "before" else F.min(anchor_time)
    bounds = anchors.groupBy(*(on or [])).agg(at.alias("_bound"))
    joined = df.join(bounds, on) if on else df.join(F.broadcast(bounds))
    test = F.col(time) < F.col("_bound") if side == "before" else F.col(time) > F.col("_bound")
    return joined.where(test).drop("_bound")


def join_records(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, str]], how: str = "inner") -> DataFrame:
    """inner, left, semi or anti join on conditions (left field, eq or not_eq, right field), null-safe.

    Right columns are prefixed right_. Equalities are what the join is partitioned by; Spark chooses its kind. Conditions
    of not_eq alone leave nothing to partition by, so at least one eq is asked for.
    """
    kinds = {"inner": "inner", "left": "left_outer", "semi": "left_semi", "anti": "left_anti"}
    if not any(op == "eq" for _, op, _ in conditions):
        raise ValueError("a join needs at least one equality")
    named = right.toDF(*[f"right_{c}" for c in right.columns])
    on = F.lit(True)
    for a, op, b in conditions:
        on = on & compare(left[a], op, named[f"right_{b}"])
    return left.join(named, on, kinds[how])


def group_records(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def group_members(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each record with the count of its group; null keys are groups too. Members stay rows, so a large group is in no one's memory."""
    counts = group_records(df, keys).toDF(*[f"_{k}" for k in keys], "count")
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(counts[f"_{k}"])
    return df.join(counts, on).drop(*[f"_{k}" for k in keys])


def union_records(lists: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Records of several lists by key, each key once: that of the first list that has it, and within a list the first by `order`."""
    every = None
    for turn, one in enumerate(lists):
        tagged = one.withColumn("_turn", F.lit(turn))
        every = tagged if every is None else every.unionByName(tagged)
    return first_seen(every, keys, ["_turn", *order]).drop("_turn")


def count_distinct(df: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct combinations; one with nulls counts as a value."""
    return df.groupBy(*(by or [])).agg(F.count_distinct(F.struct(*fields)).alias("count_distinct"))


def aggregate(df: DataFrame, calls: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """{name: (minimum, maximum, sum or average, field)}, globally or by keys."""
    kinds = {"minimum": F.min, "maximum": F.max, "sum": F.sum, "average": F.avg}
    return df.groupBy(*(by or [])).agg(*[kinds[kind](field).alias(name) for name, (kind, field) in calls.items()])


def exists_records(df: DataFrame) -> DataFrame:
    return df.agg((F.count(F.lit(1)) > 0).alias("exists"))


def collect_evidence(df: DataFrame, by: list[str], evidence: str) -> DataFrame:
    """Distinct evidence ids of each group, from rows that carry arrays of them; distinct before they are gathered."""
    spread = df.select(*by, F.explode_outer(evidence).alias("_id")).distinct()
    return spread.groupBy(*by).agg(F.sort_array(F.collect_list("_id")).alias(evidence))


def sort_keys(keys: list[tuple[str, str, str]], tie: str) -> list[Column]:
    """(field, asc or desc, first or last) for nulls; the tie field makes the order total."""
    return [getattr(F.col(f), f"{way}_nulls_{nulls}")() for f, way, nulls in keys] + [F.col(tie).asc()]


def sort_records(df: DataFrame, keys: list[tuple[str, str, str]], tie: str) -> DataFrame:
    return df.orderBy(*sort_keys(keys, tie))


def limit_records(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(count)


def rank_records(df: DataFrame, field: str, tie: str, way: str = "desc", top: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Records with their rank by a field, nulls last.

    With keys, ranks are per group. A top list without keys is cut before it is ranked, so that only its rows meet. A
    whole ranking is dealt by ranges of the order, written once, and ranks each range on its own, with the counts before
    it added: one row a range.
    """
    order = sort_keys([(field, way, "last")], tie)
    if by:
        ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= top) if top else ranked
    if top:
        return df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    # read twice, so it is written: a plan that samples its ranges anew, or prunes columns, would deal rows otherwise
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before), "_part").withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each combination of keys, by an order; a partial minimum before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def distinct_records(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.select(*fields).distinct() if fields else df.distinct()


def compare_sets(left: DataFrame, right: DataFrame, key: str, mode: str) -> DataFrame:
    """overlap and difference: ids in both, or in the left alone; values: whether both have the same ids; populations: both counts."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    if mode == "overlap":
        return a.intersect(b)
    if mode == "difference":
        return a.exceptAll(b)
    sided = a.withColumn("_l", F.lit(1)).unionByName(b.withColumn("_r", F.lit(1)), allowMissingColumns=True)
    if mode == "values":
        ids = sided.groupBy(key).agg(F.count("_l").alias("_l"), F.count("_r").alias("_r"))
        return ids.agg(F.coalesce(F.every(F.col("_l") == F.col("_r")), F.lit(True)).alias("equal"))
    if mode == "populations":
        return sided.agg(F.count("_l").alias("left_count"), F.count("_r").alias("right_count"))
    raise ValueError(f"no comparison {mode!r}")


def merge_by_authority(current: DataFrame, incoming: DataFrame, keys: list[str], authority: str) -> DataFrame:
    """Both tables by key: an incoming row replaces a current one unless its authority is lower."""
    both = current.withColumn("_turn", F.lit(0)).unionByName(incoming.withColumn("_turn", F.lit(1)))
    return latest_per_key(both, keys, [authority, "_turn"]).drop("_turn")


def preferred_claims(claims: DataFrame, keys: list[str], value: str, authority: str) -> DataFrame:
    """The value of the highest authority of each key, where that is one value; no value (null) is one, too."""
    top = claims.groupBy(*keys).agg(F.max(authority).alias("_top"))
    held = claims.join(top, keys).where(F.col(authority) == F.col("_top"))
    found = held.groupBy(*keys).agg(F.count_distinct(F.struct(value)).alias("_n"), F.first(value, ignorenulls=True).alias(value), F.first("_top").alias(authority))
    return found.where("_n = 1").drop("_n")


def detect_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value, and their values in order."""
    found = df.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys)
    return found.agg(F.count(F.lit(1)).alias("n_values"), F.sort_array(F.collect_list(value)).alias("values")).where("n_values > 1")


def in_scope(df: DataFrame, scope: dict[str, object]) -> DataFrame:
    """Rows of one workspace, generation and configuration; on partition columns this prunes files."""
    held = F.lit(True)
    for field, value in scope.items():
        held = held & (F.col(field) == F.lit(value))
    return df.where(held)


def require_scope(df: DataFrame, scope: dict[str, object]) -> DataFrame:
    """The same rows; a row of another scope fails the read."""
    checks = [F.when(~F.col(f).eqNullSafe(F.lit(v)), F.raise_error(F.lit(f"{f} is not {v}"))).otherwise(F.col(f)).alias(f) for f, v in scope.items()]
    rest = [c for c in df.columns if c not in scope]
    return df.select(*checks, *rest).select(*df.columns)


def tombstone(df: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not deleted."""
    return df.join(deleted.select(key).distinct(), key, "left_anti")


def mark_deleted(df: DataFrame, deleted: DataFrame, key: str, at: Column) -> DataFrame:
    """deleted_at is set for deleted keys and never moved: doing it twice changes nothing."""
    marks = deleted.select(F.col(key).alias("_key"), F.lit(True).alias("_gone")).distinct()
    old = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    joined = df.withColumn("deleted_at", old).join(marks, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), at))).drop("_key", "_gone")


def mark_cascade(documents: DataFrame, versions: DataFrame, logical: DataFrame, chunks: DataFrame, deleted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with deleted_at set for deleted documents (document_id) and all that belongs to them; set marks never move.

    versions: version_id, document_id; logical: logical_id, version_id; chunks: chunk_id, version_id.
    """
    gone = deleted.select("document_id").distinct()
    lost = versions.join(gone, "document_id", "left_semi").select("version_id").distinct()
    return mark_deleted(documents, gone, "document_id", at), mark_deleted(versions, lost, "version_id", at), mark_deleted(logical, lost, "version_id", at), mark_deleted(chunks, lost, "version_id", at)


def retention(df: DataFrame, finished: str, days: int, now: Column | None = None) -> DataFrame:
    """Finished rows older than so many days."""
    return df.where(F.col(finished) < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))
