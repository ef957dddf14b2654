"""Each operator against brute force over odd documents, empty tables and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import bpe, exact, langid, licenses, minhash, mixing, quality_model, repeats, rules, tokenfile
from marginalia.llm.chunks import ChunkTable

from .helpers import SCHEMA, base_counts, components, frame, odd_rows, without_repeats

ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("length,gram,hot", [(60, 12, 20_000), (200, 40, 20_000), (60, 12, 2), (60, 12, 8)])
def test_repeats(docs, length, gram, hot):
    got = sorted(tuple(r) for r in repeats.remove_repeats(docs, length, gram, hot_occurrences=hot).collect())
    assert got == without_repeats(ROWS, length)


def test_repeat_groups_have_all_occurrences(spark):
    """Passages within a text, in neighbours and in far partitions: each maximal repeat, with those that hold it, has every place of its bytes."""
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passages = [word(90), word(70), word(120)]
    rows = [(i, word(150) + "".join(word(40) + passages[int(k)] for k in rng.integers(0, 3, 3)) + word(20), None, None, None) for i in range(60)]
    texts = {i: t for i, t, *_ in rows}
    for parts in (1, 7):
        found = repeats.repeated_strings(frame(spark, rows, parts), 60, 12).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.repeat, []).append(r)
        below = {}
        for r in found:
            below.setdefault(r.parent, set()).add(r.repeat)
        for repeat, own in groups.items():
            subtree = [repeat]
            for x in subtree:
                subtree += below.get(x, ())
            places = {(r.key, r.start) for x in subtree for r in groups[x]}
            text = texts[own[0].key][own[0].start : own[0].start + own[0].size]
            every = {(i, m.start()) for i, t in texts.items() for m in re.finditer(f"(?={re.escape(text)})", t)}
            assert {r.occurrences for r in own} == {len(places)} and places == every
        covered = {(r.key, i) for r in found for i in range(r.start, r.start + r.size)}
        assert all((i, at) in covered for i, t in texts.items() for p in passages for m in re.finditer(p, t) for at in range(m.start(), m.end()))


def test_repeats_ids(spark):
    """Null ids, an id of two texts."""
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(None, text, None, None, None), (1, "head " + text, None, None, None), (1, "other", None, None, None), (2, text[100:], None, None, None)]
    got = sorted((r[0] or -1, *r[1:]) for r in repeats.remove_repeats(frame(spark, rows), 80, 16).collect())
    assert got == sorted((i if i > 0 else -1, *r) for i, *r in without_repeats([(i or -1, *r) for i, *r in rows], 80))


def test_repeats_beyond_16_mib(spark):
    """A repeat near the end of a text of over 2**24 bytes, with another document and within the text."""
    draw = lambda seed, n: np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    size, shared, twice = (1 << 24) + 300_000, "<" + draw(1, 300) + ">", "[" + draw(2, 250) + "]"
    long = draw(3, size) + shared + draw(4, 1000) + twice + draw(5, 1000) + twice + "."
    rows = [(1, long, None, None, None), (2, "0" + shared + "1", None, None, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    rest = long.replace(shared, "").replace(twice, "")
    assert got == {1: (len(long) - len(rest), 3, hashlib.sha256(rest.encode()).hexdigest()), 2: (len(shared), 1, hashlib.sha256(b"01").hexdigest())}


def test_interval_tree():
    nodes, leaves = repeats.interval_tree([b"xxabcdefghijkl1", b"yyabcdefghijkl2", b"zzabcdefghixkl3"], 8)
    found = {(n, k) for n, k, _, _ in nodes}
    assert found == {(12, 2), (9, 3)}
    assert {(s, o) for s, o, _ in leaves} == {(0, 2), (1, 2), (2, 2)}
    child = next(i for i, x in enumerate(nodes) if x[0] == 12)
    assert nodes[nodes[child][2]][0] == 9


def test_bpe_and_token_files(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = ROWS + [(500, "a<|endoftext|>b c", None, None, None), (501, "q" * 700 + "ab" * 500 + " don't we'll \x1c x", None, None, None), (None, "no id", None, None, None)]
    df = frame(spark, rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want2, want3, start = [], [], 0
    for i, text, *_ in sorted(rows, key=key):
        ids = plain.encode_ordinary(text or "")
        want2.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        want3.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in bpe.encode_documents(df).collect()) == order(want2)
    assert order(tuple(r) for r in tokenfile.token_files(df).collect()) == order(want3)


def test_token_pages(spark, tmp_path, monkeypatch):
    """Short documents share pages and blocks, a long one has its own; starts count all ids before a document."""
    rows = [(i, "word " * n, None, None, None) for i, n in enumerate([1, 0, 3, 70_000, 2, 5] + [1] * 300)] + [(None, "null", None, None, None)]
    tokenfile.write_token_files(frame(spark, rows, 2), str(tmp_path / "files"))
    pages = spark.read.parquet(str(tmp_path / "files")).collect()
    assert sum(p.n_ids for p in pages) == sum(sum(p.sizes) for p in pages) and len(pages) < 20
    assert all(len(p.block_starts) == 4 * -(-p.n_ids // tokenfile.BLOCK) for p in pages)
    found = sorted(tokenfile.read_token_files(spark, str(tmp_path / "files")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, *range(306)]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert all(len(r.ids) == 4 * r.n_tokens and r.ids[-4:] == (2).to_bytes(4, "little") for r in found)


def test_chunks_join_to_the_text():
    def encode(chunks, sure):
        joined = "".join(chunks)
        return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.array([len(x) for x in chunks])

    table = ChunkTable(encode, kept=50)
    texts = [t or "" for _, t, *_ in ROWS] + ["a \n b", " \n", "\n\n x", "x \n\ny", "  "]
    for part in (texts[:60], texts[60:]):
        flat, sizes = table.gather(table.numbers(part))
        ends = np.cumsum(sizes)
        assert [flat[b - n : b].tobytes().decode("utf-32-le") for b, n in zip(ends, sizes)] == part


def test_decodings_go_with_their_chunks(monkeypatch):
    """A slice that makes the worker's chunks begin anew and has more of them than the one before."""
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    bpe._tables.cache_clear()
    texts = [" ".join(f"{name}{i}" for i in range(n)) for name, n in [("a", 60), ("b", 90), ("c", 120), ("d", 10), ("e", 60)]]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts)]
    made = [b.column(3)[0].as_py() for b in bpe._encode(bpe.default_path(), bpe.default_pattern(), False)(iter(batches))]
    bpe._tables.cache_clear()
    assert made == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("high", [1, 3, 300, 50_257, 2**32])
def test_blocks(high):
    rng = np.random.default_rng(high)
    sizes = rng.integers(1, 400, 60)
    flat = rng.integers(0, high, sizes.sum(), dtype=np.uint64).astype(np.uint32)
    flat[rng.random(len(flat)) < 0.9] //= 50
    payloads, index = tokenfile.encode_blocks(flat, sizes)
    assert (tokenfile.decode_blocks(payloads, index, sizes) == flat).all()
    assert all(len(x) == 4 * -(-n // tokenfile.BLOCK) for x, n in zip(index, sizes))


def test_quality_model(spark, docs, labels):
    rows = quality_model.classify_quality(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = quality_model.classify_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_model_by_hand(spark, docs, labels):
    """Every score from one matrix of all labelled rows, with the isotonic fit by its min-max formula."""
    twice = labels.unionByName(labels.where("doc_id < 20"))  # repeated labels count each time
    marks = {}
    for r in twice.collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    stats = [(i, np.array(quality_model.statistics((t or "").encode()))) for i, t, *_ in ROWS]
    learned = [(x, q) for i, x in stats if zlib.crc32(str(i).encode()) % 5 for q in marks.get(i, [])]
    x, y = np.array([a for a, _ in learned]), np.array([float(q) for _, q in learned])
    spread = x.std(0)
    model = quality_model.Model(x.mean(0), np.where(spread > 1e-9, spread, 1.0), quality_model.FEATURES, quality_model.SEED, quality_model.WIDTH)
    z = model.expand(x)
    model.weights = np.linalg.solve(z.T @ z + quality_model.RIDGE * len(x) * np.eye(z.shape[1]), z.T @ y)
    edges = np.linspace(-0.5, 1.5, quality_model.BINS + 1)
    bins = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, quality_model.BINS - 1)
    used = np.unique(bins)
    mean = lambda a, b: y[(bins >= a) & (bins <= b)].mean()
    fit = np.array([max(min(mean(a, b) for b in used if b >= i) for a in used if a <= i) for i in used])
    at, count = (edges[used] + edges[used + 1]) / 2, np.array([(bins == i).sum() for i in used])
    points = [(np.average(at[np.isclose(fit, v)], weights=count[np.isclose(fit, v)]), v) for v in sorted(set(np.round(fit, 12)))]
    model.points = tuple(np.array(p) for p in zip(*points))
    want = sorted((i, round(float(s), 5)) for (i, _), s in zip(stats, model.score(np.array([v for _, v in stats]))))
    got = sorted((r.doc_id, round(r.score, 5)) for r in quality_model.classify_quality(docs, twice).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-3)


def test_null_ids_and_clashing_columns(spark):
    """Rows without an id, repeated rows and ids of two texts get a row each, whatever else the table holds."""
    text = "the house over the night and nothing else that of it"
    kinds = "doc_id long, text string, lang string, source string, label string, score double, digest string, size long, bucket int, inclusion double, same string"
    rows = [(i, t, "en", s, "x", 0.5, "d", 7, 1, 0.1, "s") for i, t, s in [(None, text, "a"), (None, None, None), (1, text, "a"), (1, text, "a"), (1, "another text of id one", "b"), (2, "", None)]]
    docs = spark.createDataFrame(rows, kinds)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    odd = exact.odd_ids()
    made = {
        "repeats": repeats.remove_repeats(docs, 40, 8), "bpe": bpe.encode_documents(docs), "files": tokenfile.token_files(docs), "model": quality_model.classify_quality(docs, labels), "exact": exact.dedup_batch(docs, odd),
        "mix": mixing.mix_sources(docs), "rules": rules.quality_rules(docs, labels), "languages": langid.identify_languages(docs), "licenses": licenses.scan_licenses(docs, licenses.digests(spark)),
    }
    for name, found in made.items():
        assert sorted(str(r.doc_id) for r in found.select("doc_id").collect()) == ["1", "1", "1", "2", "None", "None"], name
    assert sorted(r.doc_id for r in minhash.near_duplicates(docs).collect()) == [1, 1, 1, 2]
    assert langid.with_language(docs, 0.0).columns == docs.columns
    kept = {(r.doc_id, r.text_sha256[:4]): (r.group_size, r.kept) for r in made["exact"].collect()}
    assert kept[(1, hashlib.sha256(text.encode()).hexdigest()[:4])] == (3, True) and kept[(None, hashlib.sha256(text.encode()).hexdigest()[:4])] == (3, False)


def test_quality_model_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_model.op4_quality_model(spark, d).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_isotonic():
    x, y = quality_model.isotonic(np.array([2, 2, 0, 4]), np.array([1, 2, 0, 1]), np.arange(4.0))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


@given(st.lists(st.tuples(st.integers(0, 200), st.floats(0, 1)), max_size=40))
def test_isotonic_is_the_monotone_fit(bins):
    counts, goods = np.array([c for c, _ in bins], float), np.array([round(c * p) for c, p in bins], float)
    x, y = quality_model.isotonic(counts, goods, np.arange(float(len(bins))))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and ((y >= 0) & (y <= 1)).all()
    used = [i for i in range(len(bins)) if counts[i]]
    for i in used:  # the fit of each bin by the min-max formula
        mean = lambda a, b: goods[a : b + 1].sum() / counts[a : b + 1].sum()
        want = max(min(mean(a, b) for b in used if b >= i) for a in used if a <= i)
        assert np.abs(y - want).min() < 1e-9


def test_sums_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "FAN_IN", 2)
    rows = spark.range(0, 100, 1, 9).select(F.array(F.col("id").cast("double")).alias("stats"), F.lit(1.0).alias("label"))
    assert quality_model._summed(rows, 1, lambda x, y: x.sum(0)) == [4950.0]


def _revisions(seed):
    """Texts of trees of revisions, in long chains: links between neighbours, bands shared far beyond them."""
    rng, rows = np.random.default_rng(seed), []
    for tree in range(6):
        texts = [[f"w{tree}_{x}" for x in rng.integers(0, 10**6, 70)]]
        while len(texts) < 30:
            words = list(texts[rng.integers(len(texts)) if rng.random() < 0.3 else -1])
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = f"n{rng.integers(10**6)}"
            texts.append(words)
        rows += [" ".join(t) for t in texts]
    return [(int(i), rows[k], None, None, None) for i, k in enumerate(rng.permutation(len(rows)))]


@pytest.mark.parametrize("kwargs", [{}, {"piece_members": 3}, {"block_shingles": 300, "piece_shingles": 200}])
def test_near_duplicates_of_revisions(spark, kwargs):
    rows = _revisions(len(kwargs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), words=4, **kwargs).collect()}
    assert got == components(rows, 4)


def test_near_duplicates_recall(spark):
    """All links of a whole table, by brute force."""
    d = "/root/testdata/sf0.01"
    want = components([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()], 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op5_near_duplicates(spark, d).collect()} == want


def test_verified_links_are_alike(spark):
    """Sets that share a band and little else are not linked, whatever their band's least member is."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 100).astype(np.uint64)
    keep = lambda n: np.unique(np.concatenate([base[:n], rng.integers(0, 2**62, 100 - n).astype(np.uint64)]))
    sets = [keep(45) for _ in range(40)] + [keep(97) for _ in range(10)]
    codes, low = minhash.signatures(sets, 32, 4, 11)
    rows = [(i, len(s), codes[i].view(np.int64).tolist(), bytearray(low[i].tobytes())) for i, s in enumerate(sets)]
    firsts = spark.createDataFrame(rows, "doc_id long, n_shingles long, bands array<long>, minima binary")
    found = {(r.a, r.b) for r in minhash.verified_links(firsts, 128, 80, piece_members=7).collect()}
    assert all(min(x) >= 40 for x in found) and len({i for x in found for i in x}) == 10


@pytest.mark.parametrize("kwargs", [{}, {"block_shingles": 150, "piece_shingles": 100}])
def test_near_duplicates(docs, kwargs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=4, **kwargs).collect()}
    assert got == components(ROWS, 4)


def test_resolve_needs_no_pairs():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**40, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 2**40, 12).astype(np.uint64)])) for p in rng.choice([0.8, 0.95, 1.0], 60)]
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[root == root[i]] = root[j]
    low = np.array([np.flatnonzero(root == r).min() for r in root])
    assert (minhash.resolve(np.arange(len(sets)), sets, 80) == low).all()


def test_resolve_revision_trees():
    """Clusters joined by few links, where the largest component changes on the way: all pairs say the same."""
    rng = np.random.default_rng(7)
    for _ in range(600):
        n = int(rng.choice([40, 80]))
        fresh = lambda k: rng.integers(0, 2**62, k).astype(np.uint64)
        sets = [np.unique(fresh(60))]
        while len(sets) < n:
            parent = sets[rng.integers(len(sets)) if rng.random() < 0.5 else -1]
            k = int(rng.integers(1, 9))
            sets.append(np.unique(np.concatenate([rng.permutation(parent)[k:], fresh(k)])))
        keys, at = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.zeros((n, len(keys)), np.float32)
        member[np.repeat(np.arange(n), [len(s) for s in sets]), at] = 1
        both, sizes = (member @ member.T).astype(int), np.array([len(s) for s in sets])
        linked = 100 * both >= 80 * (sizes[:, None] + sizes - both)
        low = np.arange(n)
        while (now := np.where(linked, low, n).min(axis=1)).tolist() != low.tolist():
            low = now
        assert (minhash.resolve(np.arange(n), sets, 80) == low).all()


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in minhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(docs, digest):
    odd = F.col("doc_id") % 2 == 1
    found = exact.exact_dedup(docs.where(~odd), docs.where(odd), **({"digest": digest} if digest else {}), bucket_rows=10)
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(i)
    want = sorted((i, i % 2 == 0, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_screen_rejects_what_the_snapshot_lacks(spark):
    """Filters let all digests of the snapshot through and hardly any other: only those reach the exact buckets."""
    digest = F.sha2(F.col("id").cast("string"), 256).alias("digest")
    old, filters = exact.snapshot_tables(spark.range(0, 4000).select(digest), 16)
    asked = exact.screen(spark.range(3000, 9000).select("id", digest), filters, 16)
    got = {r.id for r in asked.where("maybe").collect()}
    assert asked.count() == 6000 and got >= set(range(3000, 4000)) and len(got) < 1000 + 0.02 * 5000
    assert old.groupBy("bucket").count().count() == filters.count() == 16


def test_fuse_filter():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 10, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = exact.build_filter(keys)
        assert exact.ask_filter(keys, *made).all()
        assert exact.ask_filter(rng.integers(0, 2**63, 5000).astype(np.uint64), *made).mean() < 0.02


def _mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    of = {}
    for r, n in zip(rows, size):
        of[r[3]] = of.get(r[3], 0) + n
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size), {}, set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * of[s]}
        for s in full or open_:
            target[s] = 2.0 * of[s] if full else rate * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return size, of, target


def test_mixing(spark, docs):
    size, of, target = _mix(ROWS)
    rows = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((r[0], n) for r, n in zip(ROWS, size))
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == of[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(n for r, n in zip(ROWS, size) if r[3] == s) / 2 + 1
    for s in of:  # inclusion is proportional to size up to 1, and its words are what whole copies leave
        own = [r for r in rows if r.source == s and r.size]
        left = target[s] - int(target[s] // of[s]) * of[s] if of[s] else 0
        assert sum(r.size * r.inclusion for r in own) == pytest.approx(left, abs=1e-6)
        ratio = {round(r.inclusion / r.size, 12) for r in own if r.inclusion < 1}
        assert len(ratio) <= 1 and all(r.size * min(ratio, default=0) >= 1 - 1e-9 for r in own if r.inclusion == 1 and ratio)
        assert all(r.copies == int(target[s] // of[s]) + 1 for r in own if r.inclusion == 1)
    again = frame(spark, ROWS, 7)
    assert sorted(map(str, mixing.mix_sources(again, steps=3).collect())) == sorted(map(str, rows))


def test_mixing_is_unequal(spark):
    """Long documents are taken as much more often than short ones as their inclusion says; certain ones always."""
    sizes = [2] * 3000 + [8] * 3001 + [400]
    rows = [(i, "w " * n, None, "a" if i % 2 else "b", None) for i, n in enumerate(sizes)]
    found = mixing.mix_sources(frame(spark, rows), share=0.3, seed="s").collect()
    for source in "ab":
        for n in (2, 8, 400):
            own = [r for r in found if r.source == source and r.size == n]
            if own:
                assert {r.inclusion for r in own} == {own[0].inclusion}
                assert np.mean([r.copies for r in own]) == pytest.approx(own[0].inclusion, abs=0.05)
    assert [r.copies for r in found if r.size == 400] == [1]
    other = mixing.mix_sources(frame(spark, rows), share=0.3, seed="t").where("copies > 0").collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in found if r.copies}


def test_quality_rules(docs, labels):
    rows = rules.quality_rules(docs, labels).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = [(i, *base_counts(t)) for i, t, *_ in ROWS]
    assert got == sorted((*w, w[1] < 10 or 100 * w[5] > 20 * w[1]) for w in want)
    assert all(r.kept == (not r.base_failed and r.ratio >= rules.LEAST_RATIO) for r in rows)
    only = rules.quality_rules(docs, labels.where("false")).collect()
    assert all(r.kept != r.base_failed and r.ratio == 0 for r in only)


def test_ratio_by_hand(spark, docs, labels):
    """The ratio of each document from counts of plain Python."""
    from collections import Counter

    def grams(t):
        b = (t or "").encode()
        return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 3)]

    raw, good = Counter(), Counter()
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    for i, t, *_ in ROWS:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    n, m, b = sum(raw.values()), sum(good.values()), 1 << 16
    ratio = lambda g: np.log((good[g] + 1) / (m + b)) - np.log((raw[g] + 1) / (n + b))
    want = {i: np.mean([ratio(g) for g in grams(t)]) if grams(t) else 0.0 for i, t, *_ in ROWS}
    for r in rules.quality_rules(docs, labels).collect():
        assert r.ratio == pytest.approx(want[r.doc_id], abs=1e-4)


def test_language_id(docs):
    rows = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    for i, text, lang, *_ in ROWS:
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")


def _languages_by_hand(rows):
    """Each document's prediction from sums over segmentations in plain Python."""
    pieces = set(langid.pieces_of(langid.vocabulary_path()).pieces)
    most = max(map(len, pieces))
    prior = lambda p: 40.0 ** -(1 + 0.5 * (len(p) - 1))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    def cuts(word):
        return [(a, b) for b in range(1, len(word) + 1) for a in range(max(0, b - most), b) if word[a:b] in pieces]

    counts = {}
    for i, text, lang, *_ in rows:
        if fold(i) or text is None or lang is None:
            continue
        own = counts.setdefault(lang, {})
        for word in langid._words(text):
            ahead, behind = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
            spans = cuts(word)
            for a, b in spans:
                ahead[b] += ahead[a] * prior(word[a:b])
            for a, b in sorted(spans, reverse=True):
                behind[a] += prior(word[a:b]) * behind[b]
            for a, b in spans:
                own[word[a:b]] = own.get(word[a:b], 0) + ahead[a] * prior(word[a:b]) * behind[b] / ahead[-1]
    langs, out = sorted(counts), {}
    total = {k: sum(counts[k].values()) + 0.1 * len(pieces) for k in langs}
    for i, text, *_ in rows:
        words = langid._words(text or "")
        if not any(map(str.isalpha, text or "")):
            out[i] = ("und", 0.0)
            continue
        logs = []
        for k in langs:
            logs.append(0.0)
            for word in words:
                sums = [1.0] + [0.0] * len(word)
                for a, b in cuts(word):
                    sums[b] += sums[a] * (counts[k].get(word[a:b], 0) + 0.1) / total[k]
                logs[-1] += np.log(sums[-1])
        chance = np.exp((np.array(logs) - max(logs)) * min(1.0, 20 / max(1, len(words))))
        out[i] = (langs[int(np.argmax(chance))], chance.max() / chance.sum())
    return out


def test_language_id_by_hand(spark):
    rows = [(i, (t or "")[:150] if t is not None else None, *r) for i, t, *r in odd_rows(3, 60)] + [(900, "언어사람 über größte 中文字符" * 3, "de", None, None), (901, "언어사람 언어", "en", None, None)]
    want = _languages_by_hand(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(frame(spark, rows)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-6) for i in want)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit_languages(frame(spark, [(1, "one", "en", None, None), (2, "two", "de", None, None)], 2))


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = langid.op9_language_id(spark, d).join(langs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(langid.vocabulary_path())
    weights = np.random.default_rng(0).random((len(pieces), 2)) / 1000
    index = {p: i for i, p in enumerate(pieces.pieces)}
    words = [b"a", b"hello", b"wordy", "ñandú".encode(), "언어사람".encode() * 4, b"thirteenlong", b"internationalisation" * 9]
    got = langid._log_sums(pieces, weights, words)
    for word, row in zip(words, got):
        for k in (0, 1):
            sums = [1.0] + [0.0] * len(word)
            for i in range(1, len(word) + 1):
                sums[i] = sum(sums[i - n] * weights[index[word[i - n : i]], k] for n in range(1, i + 1) if word[i - n : i] in index)
            if sums[-1] > 0:
                assert row[k] == pytest.approx(np.log(sums[-1]), rel=1e-9)
    times = np.ones((len(words), 1))
    expected = langid._expected(pieces, langid._prior_weights(pieces), words, times)
    assert sum(len(p) * expected[i, 0] for i, p in enumerate(pieces.pieces)) == pytest.approx(sum(map(len, words)))


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"][0]
    rows = [
        (1, mit.replace("<year> <copyright holders>", "2024 Somebody").upper(), None, None, None),
        (2, mit + "\nand more", None, None, None),
        (3, "Copyright (c) 2020 A\nCOPYRIGHT 2021 B\n\n" + mit.replace("sublicense", "sublicence").replace(",", " ,"), None, None, None),
        (4, None, None, None, None),
        (5, "Copyright 2020 nobody\n(c) 2021", None, None, None),
        (6, licenses.LICENSES["0BSD"][0].upper().replace(" ", "  "), None, None, None),
        (6, licenses.LICENSES["0BSD"][0].upper().replace(" ", "  "), None, None, None),
    ]
    found = licenses.scan_licenses(frame(spark, rows), licenses.digests(spark)).collect()
    assert sorted((r.doc_id, r.license_id, r.is_license) for r in found) == [(1, "MIT", True), (2, None, False), (3, "MIT", True), (4, None, False), (5, None, False), (6, "0BSD", True), (6, "0BSD", True)]


def test_full_licenses(spark):
    """Documents that are exactly a standard licence, set in other lines and cases, without the how-to, and cut short."""
    want = {"Apache-2.0": "Version 2.0, January 2004", "GPL-2.0-only": "Version 2, June 1991", "GPL-3.0-only": "Version 3, 29 June 2007", "LGPL-2.1-only": "Version 2.1, February 1999", "LGPL-3.0-only": "Version 3, 29 June 2007", "MPL-2.0": "Mozilla Public License Version 2.0", "BSD-3-Clause": "Neither the name of the copyright holder"}
    rows, names = [], {}
    for i, (name, mark) in enumerate(want.items()):
        text = max(licenses.LICENSES[name], key=lambda t: (mark in t, len(t)))
        assert mark in text
        for k, t in enumerate([text, text.upper().replace("\n", "\r\n  "), text[:-200]]):
            rows.append((10 * i + k, t, None, None, None))
            names[10 * i + k] = name if k < 2 else None
        if "END OF TERMS" in text:
            rows.append((10 * i + 5, text.split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n", None, None, None))
            names[10 * i + 5] = name
    found = licenses.scan_licenses(frame(spark, rows), licenses.digests(spark)).collect()
    assert {r.doc_id: r.license_id for r in found} == names


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        repeats.remove_repeats(none), bpe.encode_documents(none), tokenfile.token_files(none), quality_model.classify_quality(none, labels), minhash.near_duplicates(none),
        exact.exact_dedup(none, none), mixing.mix_sources(none), rules.quality_rules(none, labels), langid.identify_languages(none), licenses.scan_licenses(none, licenses.digests(spark)),
    ]
    assert [df.count() for df in made] == [0] * 10
