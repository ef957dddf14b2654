"""The trie, the rotated codes and the manifest against brute force on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marginalia.llm import ann, manifest, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        n = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = convs.get(c - math.fmod(c, 20), [])[:n] + own[n:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = {}
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in own if len(built[c]) == len(path))
        out[own[0], len(path)] = (members[path[:-1]][0] if path else None, len(own), sum(len(p) == len(path) + 1 for p in below), len(leaf), saved, h(ends))
    return out


def turn_rows(seed, n):
    rnd = random.Random(seed)
    said = ["hello there", "yes", "", None, "no no no", "tell me more about it", "ñ ß 語"]
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]) if t > 5 else "user", rnd.choice(said[: 2 + t % 6]), "kept", 1))
    rows += [(1000, t, "user", "again and again", "x", 2) for t in range(75)]  # long
    rows += [(1001, t, "user", "again and again" if t != 70 else "stop", "x", 2) for t in range(75)]
    rows += [(c, t, "user", f"copy {t}", "x", 2) for c in range(2000, 2040) for t in range(6)]
    return rows + [(1001, 3, "user", "again and again", "x", 2), (None, 1, "user", "lost", "x", 2), (-25, 0, "user", "before", "x", 2)]


SAID = "conv_id long, turn long, role string, text string, at string, size int"


@pytest.mark.parametrize("chunk", [1024, 2])
def test_prefix_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = turn_rows(chunk, 60)
    found = trie.prefix_trie(*trie.shared_openings(trie.turns(spark.createDataFrame(rows, SAID)))).collect()
    assert {(r[0], r[1]): tuple(r)[2:] for r in found} == plain_trie([r[:4] for r in rows])
    assert len({(r[0], r[1]) for r in found}) == len(found)


def test_prefix_trie_of_copies_and_nothing(spark):
    def run(rows):
        return trie.prefix_trie(*trie.shared_openings(trie.turns(spark.createDataFrame(rows, SAID)))).collect()

    assert run([]) == []
    rows = [(c, 0, "user", "same", "x", 1) for c in range(30)]
    assert {(r[0], r[1]): tuple(r)[2:] for r in run(rows)} == plain_trie([r[:4] for r in rows])


def test_ids_of_a_node_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_BYTES", 100)
    found = trie.hashed_ends(spark.range(300).selectExpr("concat('n', cast(least(id % 10, 3) as string)) AS node", "id AS conv_id").repartition(5)).collect()
    want = defaultdict(list)
    for i in range(300):
        want[f"n{min(i % 10, 3)}"].append(str(i))
    assert dict(map(tuple, found)) == {k: h(",".join(x)) for k, x in want.items()}


def plain_nearest(rows, k=10, step=100):
    sound, seen = [], set()
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            sound.append((i, v))
    out = []
    for q, x in sound:
        if q % step == 0:
            near = []
            for i, v in sound:
                if i != q and len(v) == len(x):
                    total = 0.0
                    for a, b in zip(v, x):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), i))
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, code string, length int"


@pytest.mark.parametrize("dim,epsilon", [(24, ann.EPSILON), (3, ann.EPSILON), (1, ann.EPSILON)])
def test_nearest(spark, monkeypatch, dim, epsilon):
    monkeypatch.setattr(ann, "LEAST_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rnd = np.random.default_rng(dim)
    means = rnd.normal(size=(5, dim))
    rows = [(i, (means[i % 5] + rnd.normal(size=dim)).tolist(), "x", 1) for i in range(700)]
    same = rows[100][1]
    rows += [(i, same, "x", 1) for i in range(700, 760)]  # ties
    rows += [(800, None, "x", 1), (801, [0.0] * dim, "x", 1), (802, [math.nan] * dim, "x", 1), (803, [None] * dim, "x", 1), (804, [math.inf] * dim, "x", 1), (900, [], "x", 1)]
    rows += [rows[200], rows[5], (None, same, "x", 1), (1000, [1e200] * dim, "x", 1), (1001, [1.0] * (dim + 1), "x", 1), (1100, [2.0] * (dim + 1), "x", 1)]
    sound = ann.valid(spark.createDataFrame(rows, VECTORS).repartition(3), "vec_id", "embedding")
    found = sorted(tuple(r)[:4] for r in ann.nearest(sound, sound.where("vec_id % 100 = 0"), epsilon=epsilon).collect())
    want = plain_nearest(rows)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert len(set(found) & set(want)) >= 0.99 * len(want)
    assert all(math.isclose(a[3], b[3]) or a[3] == b[3] for a, b in zip(found, want))


def test_bounds_hold(spark):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(4000, 64))
    centres = ann.fit_centres(vectors[:500])
    near, codes, length, agree = ann.encode(vectors, centres)
    import pyarrow as pa

    rows = pa.table({"vec_id": np.arange(4000), "vector": pa.array(list(vectors)), "centre": near.astype(np.int32), "code": [x.tobytes() for x in codes], "length": length, "agree": agree})
    block = ann.Block(rows, 64, centres)
    for query in rnd.normal(size=(20, 64)):
        guess, lower = block.bounds(query, ann.EPSILON)
        true = ((vectors - query) ** 2).sum(axis=1)
        assert (lower <= true).mean() > 0.9995
        assert abs(np.mean(guess - true)) < 1  # unbiased


def test_nearest_of_nothing(spark):
    none = ann.valid(spark.createDataFrame([], VECTORS), "vec_id", "embedding")
    assert ann.nearest(none, none).collect() == []
    few = ann.valid(spark.createDataFrame([(0, [1.0, 2.0], "x", 1), (7, [1.0, 1.0], "x", 1)], VECTORS), "vec_id", "embedding")
    assert [tuple(r)[:4] for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 7, 1.0)]


def plain_manifest(rows, fanout=2):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, more=0):
        i, text, lang, source, n = r[:5]
        return h(*map(field, (i, source, lang, None if n is None else n + more, text)))

    def grow(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // fanout * fanout
            out.append((level[first:at], level[at + 1 : first + fanout]))
            at //= fanout
        return out

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = grow([leaf(r) for r in by_lang[lang]])
    top = grow([trees[x][-1][0] for x in langs])
    out = []
    for turn, lang in enumerate(langs):
        for at, r in enumerate(by_lang[lang]):
            steps = path(trees[lang], at) + path(top, turn)
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = leaf(r, 1) if chosen else leaf(r)
            for before, after in steps:
                now = h(*before, now, *after)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], h(*[x for b, a in steps for x in (*b, *a)]), now, now == top[-1][0]))
    return sorted(out, key=repr)


LEAVES = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, path string"


def manifest_rows(n, langs):
    rnd = random.Random(n)
    rows = [(rnd.choice([i, i, i, None, 5]), rnd.choice(["", None, "tëxt", "a" * 5000, f"t{i}"]), rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([None, i, 7]), "x", 1, "p") for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n,langs", [(200, ["en", None, "de"]), (70, ["en"]), (40, [f"l{i}" for i in range(30)]), (1, [None])])
def test_manifest(spark, tmp_path, n, langs):
    rows = manifest_rows(n, langs)
    spark.createDataFrame(rows, LEAVES).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = manifest.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("fanout", [3, 4])
def test_manifest_of_other_fanouts(spark, monkeypatch, fanout):
    monkeypatch.setattr(manifest.build, "__defaults__", (fanout, 2))
    monkeypatch.setattr(manifest.descend, "__defaults__", (fanout, 2))
    rows = [r for r in manifest_rows(90, ["en", None, "de", "fr", "it"]) if r[0] is not None]
    docs = spark.createDataFrame(rows, LEAVES)
    found = manifest.manifest(docs, "lang", "doc_id", manifest.document_leaf(docs["n_chars"]), fanout=fanout)
    want = plain_manifest(rows, fanout)
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in found.collect()) == sorted(x[:4] for x in want)
    assert all(r["checked_root"] == r["root"] for r in found.collect())


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], LEAVES).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.op13_merkle_manifest(spark, str(tmp_path)).collect() == []
