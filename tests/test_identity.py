"""Replayed merges against a replay in order."""

import random

import pytest

from marginalia.operators import identity as I


def plain(entities, merges, as_of=None):
    kinds, root, ended, ops = dict(entities), {e: e for e, _ in entities}, {}, {}
    for seq, s, t in sorted(merges):
        if as_of is not None and seq > as_of:
            break
        if s not in kinds or t not in kinds:
            ops[seq] = (False, "missing", None)
        elif kinds[s] != kinds[t]:
            ops[seq] = (False, "type", None)
        elif s == t:
            ops[seq] = (False, "same", None)
        elif root[s] != s:
            ops[seq] = (False, "superseded", None)
        elif root[t] == s:
            ops[seq] = (False, "same", None)
        else:
            to, ended[s] = root[t], seq
            for e, r in root.items():
                if r == s:
                    root[e] = to
            ops[seq] = (True, None, to)
    return {e: (root[e], ended.get(e)) for e in root}, ops


def run(spark, entities, merges, as_of=None):
    survivors, operations = I.replay_merges(spark.createDataFrame(entities, "entity_id int, entity_type string"), spark.createDataFrame(merges, "seq int, source_id int, target_id int"), as_of)
    return {r[0]: (r[1], r[2]) for r in survivors.collect()}, {r["seq"]: (r["applied"], r["reason"], r["survivor_id"]) for r in operations.collect()}


CASES = {
    "chain": [(1, 1, 2), (2, 2, 3)],
    "chain backwards": [(1, 2, 3), (2, 1, 2)],
    "double": [(1, 1, 2), (2, 1, 3)],
    "cycle": [(1, 1, 2), (2, 2, 1)],
    "cycle, then on": [(1, 1, 2), (2, 2, 1), (3, 2, 1), (4, 2, 3), (5, 3, 1)],
    "long cycle": [(4, 1, 2), (3, 2, 3), (2, 3, 4), (1, 4, 1), (5, 4, 5), (6, 1, 5)],
    "back before it closes": [(1, 1, 2), (3, 2, 4), (10, 4, 1), (2, 2, 1), (11, 4, 5)],
    "missing, types, itself": [(1, 1, 9), (2, 1, 6), (3, 1, 1), (4, 9, 1)],
    }


def test_replay(spark):
    """All cases side by side: each has its own entities, so one replay has them all."""
    entities, merges = [], []
    for n, case in enumerate(CASES.values()):
        entities += [(100 * n + i, kind) for i, kind in [*((i, "p") for i in range(1, 6)), (6, "q"), (7, None), (8, None)]]
        merges += [(1000 * n + seq, 100 * n + s, 100 * n + t) for seq, s, t in [*case, (100, 7, 8)]]
    assert run(spark, entities, merges) == plain(entities, merges)


@pytest.mark.parametrize("as_of", [None, 400])
def test_replay_at_random(spark, as_of):
    rnd = random.Random(7)
    entities = [(i, rnd.choice("ppppq")) for i in range(60)]
    merges = [(seq, rnd.randrange(62), rnd.randrange(62)) for seq in rnd.sample(range(1000), 200)]
    assert run(spark, entities, merges, as_of) == plain(entities, merges, as_of)


def test_long_chain(spark):
    n = 300
    entities, merges = [(i, "p") for i in range(n + 1)], [(i, i, i + 1) for i in range(n)]
    survivors, ops = run(spark, entities, merges)
    assert {r for r, _ in survivors.values()} == {n} and all(x[2] == i + 1 for i, x in ops.items())


def test_merge_and_history(spark):
    entities = spark.createDataFrame([(i, "p", "active") for i in "abcd"], "entity_id string, entity_type string, status string")
    merges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "d", "a")], "seq int, source_id string, target_id string")
    aliases = spark.createDataFrame([(x, "same") for x in "abcd"], "entity_id string, value string")
    mentions = spark.createDataFrame([(x, f"m{x}") for x in "abcd"], "entity_id string, mention_id string")
    done, names, moved, _ = I.merge_entities(entities, aliases, mentions, merges)
    assert sorted((r.entity_id, r.status) for r in done.collect()) == [("a", "superseded"), ("b", "superseded"), ("c", "active"), ("d", "superseded")]
    assert [tuple(r) for r in names.collect()] == [("c", "same")] and {r.entity_id for r in moved.collect()} == {"c"} and moved.count() == 4
    done, _, moved, _ = I.merge_entities(entities, aliases, mentions, merges, as_of=1)
    assert {(r.entity_id, r.mention_id) for r in moved.collect()} == {("b", "ma"), ("b", "mb"), ("c", "mc"), ("d", "md")}
    rows = {(r.entity_id, r.seq): (r.role, r.other_id, r.status) for r in I.merge_history(entities, merges).collect()}
    assert rows["a", 1] == ("source", "b", "superseded") and rows["b", 1] == ("target", "a", "active") and rows["c", 3] == ("survivor", "d", "active") and rows["d", 3] == ("source", "c", "superseded")
