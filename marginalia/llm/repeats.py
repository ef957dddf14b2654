"""Repeated byte strings: enhanced suffix arrays over the places where texts may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, cut_parquet, documents, slices, text_or_empty

#: Bytes of the shortest repeat, and of the grams of which each window of that length selects one.
LENGTH = 200
GRAM = 40
#: Bytes of contexts that one suffix array holds, besides those of one gram.
ARRAY_BYTES = 6 << 20
#: Occurrences of a gram beyond which its contexts are cut into WIDTH windows each and counted instead of sorted.
HOT_OCCURRENCES = 20_000
WIDTH = 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes whose places are told apart beside a hash.
PART = 1 << 24
_PLACE = np.uint64(PART - 1)


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A + (y ^ (y >> np.uint64(29))) * _B
    return z ^ (z >> np.uint64(32))


def _hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the string of `length` (8 or more) bytes at each place; places near the end see zeros."""
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)])
    n, size = len(raw), 8
    h = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1)).copy().view(np.uint64).reshape(-1)
    h = _fold(h, np.uint64(0x27D4EB2F165667C5) + h)
    while size < length:
        step = min(size, length - size)
        h = _fold(h[: len(h) - step], h[step:])
        size += step
    return h[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row: [len(values) - width + 1]."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, windows, anchor of each window, text of each window) of the concatenation of the texts.

    windows are the places at which a string of `length` bytes begins within one text. Its anchor is the place of its
    least gram, by hash, leftmost of equals: equal strings have their anchors at the same offset.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    room = np.maximum(sizes - length + 1, 0)
    if not room.sum():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashed = _hashes(raw, gram)
    # a place is packed beside the hash, so more bytes than it can tell apart are read in overlapping parts
    wide = length - gram + 1
    least = np.zeros(len(raw) - wide + 1, np.int64)
    for begin in range(0, len(least), PART - wide + 1):
        part = hashed[begin : begin + PART] & ~_PLACE
        found = _least(part | np.arange(len(part), dtype=np.uint64), wide) & _PLACE
        least[begin : begin + len(found)] = found.astype(np.int64) + begin
    owner = np.repeat(np.arange(len(texts)), room)
    windows = np.arange(room.sum()) + np.repeat(ends - sizes - (np.cumsum(room) - room), room)
    return hashed, windows, least[windows], owner


def _select(length: int, gram: int):
    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), 2 << 20):
                texts = as_bytes(batch.column(1).slice(start, stop - start))
                hashed, _, anchor, owner = anchors(texts, length, gram)
                first = np.flatnonzero(np.diff(anchor, prepend=-1))  # an anchor serves windows in a row
                rows = np.stack([owner[first], hashed[anchor[first]].view(np.int64)], axis=1) if len(first) else np.zeros((0, 2), np.int64)
                rows, times = np.unique(rows, axis=0, return_counts=True)
                tags = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
                keys = batch.column(0).slice(start, stop - start).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(keys[rows[:, 0]]), pa.array(tags[rows[:, 0]]), pa.array(times)], ["gram", "key", "tag", "times"])

    return selected


def _listed(lists: pa.Array) -> np.ndarray:
    """[row, value] of all values of a list column."""
    own = np.repeat(np.arange(len(lists)), [len(x) if x.is_valid else 0 for x in lists])
    return np.stack([own, lists.flatten().to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def _contexts(length: int, gram: int, width: int, groups: bool):
    names = ["gram", "key", "tag", "start", "size", "context", "hot", "also"]
    member = pa.struct([("key", pa.int64()), ("tag", pa.int64()), ("start", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(1), 2 << 20):
                part = batch.slice(begin, stop - begin)
                texts = as_bytes(part.column(1))
                tags = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
                texts = [b"" if spare and tag in spare else t for t, tag, spare in zip(texts, tags.tolist(), part.column(3).to_pylist())]
                keys = part.column(0).to_numpy(zero_copy_only=False)
                hashed, windows, anchor, owner = anchors(texts, length, gram)
                if not len(windows):
                    continue
                known, crowded = _listed(part.column(2)), _listed(part.column(4))
                first = np.flatnonzero(np.diff(anchor, prepend=-1))
                mine = np.stack([owner[first], hashed[anchor[first]].view(np.int64)], axis=1)
                kind = np.unique(np.concatenate([known, crowded, mine]), axis=0, return_inverse=True)[1].reshape(-1)
                own = kind[len(known) + len(crowded) :]
                spread = lambda x: np.repeat(x, np.diff(np.append(first, len(anchor))))
                # a window whose anchor occurs once can't repeat
                open_ = spread(np.isin(own, kind[: len(known)]))
                hot = spread(np.isin(own, kind[len(known) : len(known) + len(crowded)]))
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                # windows of a crowded gram are cut by their distance from the anchor, so equal ones are cut alike
                bucket = np.where(hot[at], (anchor[at] - windows[at]) // width, -1)
                breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(anchor[at]) != 0) | (np.diff(owner[at]) != 0) | (np.diff(bucket) != 0))
                lows, highs = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)]
                bucket = bucket[np.append(0, breaks + 1)]
                whole = b"".join(texts)
                starts = np.cumsum([0, *map(len, texts)])
                froms, untils = windows[lows], windows[highs] + length
                strings = [whole[a:b] for a, b in zip(froms.tolist(), untils.tolist())]
                # equal contexts of a slice are sent once; where groups are asked for, with the places of the others
                seen: dict[bytes, int] = {}
                one = np.array([seen.setdefault(x, i) for i, x in enumerate(strings)])
                sent = one == np.arange(len(one))
                doc = owner[lows]
                crowd = np.bincount(one, minlength=len(one))[one] > 1
                known = np.flatnonzero(crowd & ((bucket >= 0) | (not groups)))
                if len(known):  # repeats as wholes: runs, dealt by document, since no gram has to meet them
                    run = np.flatnonzero(np.diff(doc[known], prepend=-1) | (froms[known] > np.append(-1, untils[known][:-1])))
                    until = np.append(untils[known][run[1:] - 1], untils[known[-1]])
                    of = doc[known][run]
                    columns = [keys[of], keys[of], tags[of], froms[known][run] - starts[of], until - froms[known][run]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(run), pa.binary()), pa.array(np.zeros(len(run), bool)), pa.nulls(len(run), pa.list_(member))], names)
                rest = np.flatnonzero(~sent & (bucket < 0) & groups)
                rest = rest[np.argsort(one[rest], kind="stable")]
                ends = np.searchsorted(one[rest], np.flatnonzero(sent), side="right")
                places = pa.StructArray.from_arrays([pa.array(x) for x in (keys[doc[rest]], tags[doc[rest]], froms[rest] - starts[doc[rest]])], fields=list(member))
                also = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), places)
                of, place = doc[sent], anchor[lows[sent]]
                meets, near = hashed[place].view(np.int64).copy(), bucket[sent]
                for i in np.flatnonzero(near >= 0):  # what all windows of such a cut share
                    core = whole[place[i] - near[i] * width : place[i] - (near[i] + 1) * width + 1 + length]
                    meets[i] = xxhash.xxh3_64_intdigest(core) - (1 << 63)
                columns = [meets, keys[of], tags[of], froms[sent] - starts[of], untils[sent] - froms[sent]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([x for x, yes in zip(strings, sent) if yes], pa.binary()), pa.array(near >= 0), also], names)

    return found


def interval_tree(strings: list[bytes], length: int, weights: np.ndarray | None = None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Maximal repeats of at least `length` bytes among the strings.

    Returns nodes (repeat length, occurrences, parent or -1, a place) and leaves (string, offset, node). A node is an
    interval of the enhanced suffix array whose suffixes share a prefix and are preceded by different bytes (the start of
    a string counts as different from all), so it can be extended neither way; a node's occurrences are the leaves of
    its subtree, each counted as often as `weights` says of its string. The array holds only suffixes that can begin one: those whose first `length` bytes occur twice with
    different bytes before them. Common prefixes of neighbours are scanned with a stack.
    """
    raw = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    room = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), room)
    places = np.arange(room.sum()) + np.repeat(ends - sizes - (np.cumsum(room) - room), room)
    if len(places) < 2:
        return [], []
    hashed = _hashes(raw, length)[places]
    order = np.argsort(hashed, kind="stable")
    edges = np.flatnonzero(np.diff(hashed[order], prepend=~hashed[order[0]]))
    count = np.diff(np.append(edges, len(order)))
    before = np.where(places > (ends - sizes)[owner], raw[places - 1].astype(np.int64), -1)[order]
    low, high = np.minimum.reduceat(before, edges), np.maximum.reduceat(before, edges)
    chosen = order[np.repeat((count > 1) & ((low != high) | (low < 0)), count)]
    if not len(chosen):
        return [], []
    # the suffix array: suffixes as rows, filled up with zeros, in byte order
    begin, stop = places[chosen], ends[owner[chosen]]
    wide = -(-int((stop - begin).max()) // 8) * 8
    rows = np.zeros((len(chosen), wide), np.uint8)
    for i, (a, b) in enumerate(zip(begin.tolist(), stop.tolist())):
        rows[i, : b - a] = raw[a:b]
    array = np.lexsort(rows.view(">u8").T[::-1])
    rows, begin, stop, who = rows[array], begin[array], stop[array], owner[chosen][array]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(stop - begin, np.roll(stop - begin, -1))[:-1]).tolist()
    upto = np.append(0, np.cumsum(np.ones(len(who), np.int64) if weights is None else weights[who])).tolist()
    left = np.where(begin > (ends - sizes)[who], raw[begin - 1].astype(np.int64), -1).tolist()
    nodes: list[tuple[int, int, int, int]] = []
    leaf_node = [-1] * len(left)
    stack: list[list] = []  # [common length, first, byte before or None if different, children]

    def close(top: list, last: int) -> None:
        # an interval of one byte before it can be extended to the left: another node covers it, so its leaves stay free
        _, first, diverse, children = top
        if not diverse:
            if stack:
                stack[-1][3].extend(children)
            return
        number = len(nodes)
        nodes.append((top[0], upto[last + 1] - upto[first], -1, first))
        for child in children:
            nodes[child] = (*nodes[child][:2], number, nodes[child][3])
        for i in range(first, last + 1):
            if leaf_node[i] < 0:
                leaf_node[i] = number
        if stack:
            stack[-1][3].append(number)

    changes = np.cumsum(np.append(0, [a != b or a < 0 for a, b in zip(left[1:], left[:-1])]))
    for i, shared in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > shared:
            top = stack.pop()
            first = top[1]
            top[2] = changes[i] != changes[first] or left[first] < 0
            if shared >= length and (not stack or stack[-1][0] < shared):
                stack.append([shared, first, False, []])
            close(top, i)
        if shared >= length and (not stack or stack[-1][0] < shared):
            stack.append([shared, first, False, []])
    offset = (begin - (ends - sizes)[who]).tolist()
    return [(n, k, up, int(begin[first])) for n, k, up, first in nodes], [(int(who[i]), offset[i], leaf_node[i]) for i in range(len(left)) if leaf_node[i] >= 0]


def _scan(length: int):
    names = ["key", "tag", "start", "size", "repeat", "parent", "occurrences"]

    def resolved(rows: pa.Table) -> pa.RecordBatch:
        # a context that stands for others is in the array twice: for itself and for them
        also = rows["also"].combine_chunks()
        others = np.diff(also.offsets.to_numpy())
        twice = np.flatnonzero(others)
        contexts = rows["context"].to_pylist()
        strings = contexts + [contexts[i] for i in twice]
        nodes, leaves = interval_tree(strings, length, np.append(np.ones(len(contexts), np.int64), others[twice]))
        whole = b"".join(strings)
        ids = np.array([xxhash.xxh3_64_intdigest(whole[at : at + n]) - (1 << 63) for n, _, _, at in nodes], np.int64)
        size, times = (np.array([x[i] for x in nodes], np.int64) for i in (0, 1))
        up = np.array([x[2] for x in nodes], np.int64)
        who, offset, node = (np.array([x[i] for x in leaves], np.int64) for i in range(3))
        # members of each string: the row's own place, or those that it stands for
        flat = also.flatten()
        every = {c: np.concatenate([rows[c].to_numpy(), flat.field(c).to_numpy()]) for c in ("key", "tag", "start")}
        first = np.append(np.arange(len(contexts)), len(contexts) + (np.cumsum(others) - others)[twice])
        count = np.append(np.ones(len(contexts), np.int64), others[twice])
        leaf = np.repeat(np.arange(len(who)), count[who])
        at = np.repeat(first[who], count[who]) + np.arange(len(leaf)) - np.repeat(np.cumsum(count[who]) - count[who], count[who])
        node = node[leaf]
        parent = pa.array(ids[np.maximum(up, 0)][node], mask=up[node] < 0) if len(nodes) else pa.nulls(0, pa.int64())
        columns = [every["key"][at], every["tag"][at], every["start"][at] + offset[leaf], size[node], ids[node]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), parent, pa.array(times[node])], names)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            nothing = pa.nulls(known.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3), known.column(4), nothing, nothing, nothing], names)
            rest = batch.filter(batch.column(5).is_valid())
            if not rest.num_rows:
                continue
            waiting.append(rest)
            held += rest.column(5).nbytes
            if held >= ARRAY_BYTES:
                rows = pa.Table.from_batches(waiting)
                grams = rows["gram"].to_numpy()
                last = int(np.searchsorted(grams, grams[-1]))  # rows come sorted by gram; the last one may go on
                if last:
                    yield resolved(rows.slice(0, last))
                    waiting = rows.slice(last).combine_chunks().to_batches()
                    held = sum(b.column(5).nbytes for b in waiting)
        if waiting:
            yield resolved(pa.Table.from_batches(waiting))

    return scanned


def _windows(length: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, a + i, c[i : i + length]) for k, t, a, c in zip(*(x.to_pylist() for x in batch.columns)) for i in range(len(c) - length + 1)]
            both = np.array([divmod(xxhash.xxh3_128_intdigest(r[3]), 1 << 64) for r in rows], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [both[:, 0], both[:, 1], *(np.array([r[i] for r in rows], np.int64) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["one", "two", "key", "tag", "start"])

    return spread


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among the cut contexts of crowded grams, found by counting: no task gathers what shares a gram.

    Cuts that share their core and are all equal repeat as wholes. Where cuts of a core differ, each of their few windows
    is counted by a 128-bit hash. Counts combine before the shuffle, and joins with them are split by AQE.
    """
    marked = contexts.select("gram", F.xxhash64("context").alias("whole"), "key", "tag", "start", "size", "context")
    cores = marked.groupBy("gram").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = marked.join(cores.select("gram", "a", "b"), "gram")
    mixed = judged.where("a <> b").select("key", "tag", "start", "context").mapInArrow(_windows(length), "one long, two long, key long, tag long, start long")
    often = mixed.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = mixed.join(often, ["one", "two"]).select("key", "tag", "start", F.lit(length).cast("long").alias("size"))
    return judged.where("a = b").select("key", "tag", "start", "size").unionByName(single)


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_occurrences: int = HOT_OCCURRENCES, width: int = WIDTH, groups: bool = True) -> DataFrame:
    """The maximal repeats of `length` bytes or more across and within documents: groups with all their occurrences.

    Returns key (doc_id, null as the least long), tag (a hash of the text), start, size, and the repeat (a hash of its
    bytes), its parent in the interval tree, and its occurrences. Rows without a repeat are repeats of crowded grams. Every window of `length` bytes selects one gram, its anchor, by content. Anchors that occur in one text only,
    and once there, can't be in a repeat. Around the others the text that may repeat is cut out, so that each window is
    in one context; contexts meet others of their gram, sorted, and an enhanced suffix array over them is scanned with a
    stack. Occurrences are maximal within their contexts; adjoining ones overlap, so a longer repeat is a row of
    occurrences. Equal contexts of a task's slice are sent once, with the places of the others, and count as all of them.
    A gram of over `hot_occurrences` occurrences is too much for one task: its contexts are cut finer and counted, and
    their rows have no repeat id. Copies of a whole text are left to the caller: only one of them is read.

    Without `groups`, for callers that need spans only, equal contexts of a slice are given as runs without a repeat id;
    one of them still meets those of other slices in the tree, so the bytes that are covered are the same. A document
    then counts as one occurrence of a gram, since it sends most of its contexts of one gram once.
    """
    plain = keyed(docs, id_col, text_col)
    chosen = plain.mapInArrow(_select(length, gram), "gram long, key long, tag long, times long")
    seen = chosen.groupBy("gram").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.max("times").alias("most"), (F.sum("times") if groups else F.count(F.lit(1))).alias("n"))
    common = cut(seen.where("a <> b or most > 1").select("gram", (F.col("n") > hot_occurrences).alias("crowded")))
    wanted = chosen.select("gram", "key").join(common, "gram").groupBy("key").agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("crowded"), F.col("gram"))).alias("crowded"))
    spare = copies(docs, id_col, text_col).where("key <> first").groupBy("key").agg(F.collect_set("tag").alias("spare"))
    wanted = wanted.join(spare, "key", "left").select("key", "grams", "spare", "crowded")
    contexts = plain.join(wanted, "key", "left").mapInArrow(_contexts(length, gram, width, groups), "gram long, key long, tag long, start long, size long, context binary, hot boolean, also array<struct<key:long,tag:long,start:long>>")
    crowd = None
    if not common.where("crowded").isEmpty():
        contexts = cut_parquet(contexts)  # read by several branches
        crowd = _crowded(contexts.where("hot"), length)
        contexts = contexts.where("not hot")
    met = contexts.drop("hot").repartition("gram").sortWithinPartitions("gram")
    found = met.mapInArrow(_scan(length), "key long, tag long, start long, size long, repeat long, parent long, occurrences long")
    return found if crowd is None else found.unionByName(crowd, allowMissingColumns=True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), text_or_empty(text_col).alias("text"))


def copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, tag, size, first) of the documents whose whole text others have; first is the least key of them.

    tag is the hash that tells texts of one key apart, size the bytes of the text.
    """
    marked = keyed(docs, id_col, text_col).select("key", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("tag"), F.octet_length("text").alias("size"))
    groups = marked.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return marked.join(groups, "digest").select("key", "tag", "size", "first")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        for start, stop in slices(batch.column(1), 2 << 20):
            part = batch.slice(start, stop - start)
            out = []
            for text, spans, copied in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                tag = xxhash.xxh64_intdigest(text, seed=42)
                tag -= (tag >> 63) << 64
                if tag in (copied or ()):
                    runs = [(0, len(text))]
                else:
                    runs = []
                    for a, n in sorted((s["start"], s["size"]) for s in spans or [] if s["tag"] == tag):
                        if runs and a <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(runs[-1][1], a + n))
                        else:
                            runs.append((a, a + n))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_occurrences: int = HOT_OCCURRENCES) -> DataFrame:
    """Each document without the bytes that a string of `length` bytes covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. Repeats are those of repeated_strings(); a text that other
    documents have as a whole is removed as a whole if it has `length` bytes. Strings are judged on the input.

    Null text counts as empty; texts under `length` bytes keep all. Rows that repeat a doc_id and its text are copies of
    each other, and with another text they are documents of their own. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    spans = repeated_strings(docs, length, gram, id_col, text_col, hot_occurrences, groups=False)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("tag", "start", "size")).alias("spans"))
    whole = copies(docs, id_col, text_col).where(F.col("size") >= length).groupBy("key").agg(F.collect_set("tag").alias("copied"))
    joined = keyed(docs, id_col, text_col).join(spans.join(whole, "key", "full"), "key", "left")
    doc = F.when(F.col("key") > -(2**63), F.col("key")).alias("doc_id")
    return joined.select(doc, "text", "spans", "copied").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_repeated_strings(spark, sf_dir) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
