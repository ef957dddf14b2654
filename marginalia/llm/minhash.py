"""Near-duplicate detection: MinHash with banding, verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, as_bytes, cut, cut_parquet, documents, mix64, slices

#: Words of a shingle and the similarity of a link as a percentage.
WORDS = 5
PERCENT = 80
#: Bands of rows of minima: two sets of similarity 0.8 share no band once in 2 * 10**7 pairs, of 0.85 once in 10**9.
BANDS, ROWS = 32, 4
SEED = 11
#: How far below the similarity of a link two signatures may agree: of links at 0.8 one in 5 * 10**8 is missed at 0.55.
SLACK = 0.25
#: Members of a band that one row of a comparison of signatures holds.
PIECE_MEMBERS = 1_000
#: Shingles of a block of candidates that one task compares; a larger block is compared in pieces.
BLOCK_SHINGLES = 4_000_000
#: Shingles of such a piece.
PIECE_SHINGLES = 400_000

_FACTORS = [int(x) | 1 for x in np.random.default_rng(1).integers(1, 2**63, 16)]


def _hash_functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Distinct shingles of each text, as sorted 64-bit hashes. Words: [^\\x20\\x09-\\x0D]+ in lower case (A-Z)."""
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        found = []
        for w in text.lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            found.append(h)
        codes = np.array(found, np.uint64)
        n = max(1, len(codes) - words + 1) if len(codes) else 0
        total = np.full(n, 0x9E3779B97F4A7C15 + min(len(codes), words), np.uint64)
        for i in range(min(words, len(codes))):
            total = mix64(total * np.uint64(_FACTORS[i]) + codes[i : i + n])
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each band of minima: [set, band], a byte of each minimum: [set, bands * rows]). Sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets)
    times, plus = _hash_functions(bands * rows, seed)
    out = np.zeros((len(sets), bands), np.uint64)
    minima = np.zeros((len(sets), bands * rows), np.uint8)
    for i in range(bands * rows):
        low = np.minimum.reduceat(flat * times[i] + plus[i], starts)
        minima[:, i] = mix64(low) >> np.uint64(56)
        out[:, i // rows] = mix64(out[:, i // rows] * np.uint64(_FACTORS[8]) + low + np.uint64(i // rows + 1))
    return out, minima


def _sign(words: int, bands: int, rows: int, seed: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near duplicates")
        for batch in batches:
            for start, stop in slices(batch.column(1), 1 << 20):
                sets = shingle_sets(as_bytes(batch.column(1).slice(start, stop - start)), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                bandings: list = [[]] * len(sets)
                minima: list = [None] * len(sets)
                if full:
                    codes, low = signatures([sets[i] for i in full], bands, rows, seed)
                    for i, row, own in zip(full, codes.view(np.int64), low):
                        bandings[i], minima[i] = row, own.tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [batch.column(0).slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bandings, pa.list_(pa.int64())), pa.array(minima, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "same", "bands", "minima"])

    return signed


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _alike(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Whether signatures agree well enough for a link; sizes alone may rule it out, exactly."""
    agreed = (a == b).sum(axis=-1)
    sizes = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return sizes & (agreed >= (percent / 100 - slack) * a.shape[-1])


def _verify(width: int, percent: int, slack: float):
    """(a, b, alike) of candidate pairs (a, b, size_a, size_b, minima_a, minima_b)."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near duplicates")
        for batch in batches:
            size_a, size_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = _alike(_bytes_of(batch.column(4), width), _bytes_of(batch.column(5), width), size_a, size_b, percent, slack)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "alike"])

    return verified


def _compare_bands(width: int, percent: int, slack: float):
    """A forest (a, b) of the pairs with well agreeing signatures between the loose members and the members of each row."""

    def fields(lists: pa.Array) -> list[tuple]:
        flat = lists.flatten()
        ids, sizes, minima = flat.field("doc_id").to_numpy(), flat.field("n_shingles").to_numpy(), _bytes_of(flat.field("minima"), width)
        ends = np.cumsum([len(x) for x in lists])
        return [(ids[a:b], sizes[a:b], minima[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near duplicates")
        for batch in batches:
            a, b = [], []
            for (ids, sizes, minima), (others, other_sizes, other_minima) in zip(fields(batch.column(0)), fields(batch.column(1))):
                for i, n, own in zip(others, other_sizes, other_minima):
                    near = ids[_alike(minima, own, sizes, n, percent, slack)]
                    a.append(near)
                    b.append(np.full(len(near), i))
            nodes, roots = _forest(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
            apart = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], ["a", "b"])

    return compared


def verified_links(firsts: DataFrame, width: int, percent: int, slack: float = SLACK, piece_members: int = PIECE_MEMBERS) -> DataFrame:
    """Links (a, b) between sets that share a band and whose signatures agree, enough of them to connect all such pairs.

    firsts: doc_id, n_shingles, bands, minima (a byte of each of `width` minima). Every member of a band is verified
    against the least one. Members that don't agree with it are loose: they are verified against all members of that
    band, in pieces of `piece_members`; what agrees with the least one is connected through it already.
    """
    sized = firsts.select("doc_id", "n_shingles", "minima")
    banded = firsts.select("doc_id", F.posexplode("bands").alias("band", "code")).select("doc_id", "code").distinct()
    least = banded.groupBy("code").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(banded.join(least, "code").where("doc_id <> low"))
    pairs = met.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sized.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("minima").alias(f"minima_{side}")), side)
    verified = cut(pairs.select("a", "b", "size_a", "size_b", "minima_a", "minima_b").mapInArrow(_verify(width, percent, slack), "a long, b long, alike boolean"))
    links = verified.where("alike").select("a", "b")
    # bands with a loose member and another one besides the least
    apart = verified.where("not alike").select(F.col("a").alias("doc_id"), F.col("b").alias("low"))
    loose = met.where("n > 2").join(apart, ["doc_id", "low"]).select("doc_id", "code").withColumn("loose", F.lit(True))
    open_ = loose.select("code").distinct()
    members = met.select("doc_id", "code", "n").join(open_, "code", "left_semi").join(loose, ["doc_id", "code"], "left").join(sized, "doc_id")
    piece = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / piece_members)).cast("int")
    row = F.struct("doc_id", "n_shingles", "minima")
    packed = members.withColumn("piece", piece).groupBy("code", "piece").agg(F.max("n").alias("n"), F.collect_list(row).alias("held"), F.collect_list(F.when(F.col("loose"), row)).alias("loose"))
    packed = cut_parquet(packed)
    alone_ = packed.where(F.col("n") <= piece_members).where(F.size("loose") > 0).select("held", "loose")
    several = packed.where(F.col("n") > piece_members)
    crossed = several.select("code", "held").join(several.where(F.size("loose") > 0).select("code", "loose"), "code").select("held", "loose")
    return links.unionByName(alone_.unionByName(crossed).mapInArrow(_compare_bands(width, percent, slack), "a long, b long"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each component. edges: (a, b) of longs.

    Large-star and small-star steps alternate until nothing changes. A step groups by one end and keeps a minimum, with
    partial sums before the shuffle, and joins it back to the links, which are split where a star is large; no task
    gathers a star. Every round is checkpointed.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        # large: every larger neighbour of a node is linked to the least of the node and its neighbours;
        # small: every node and its smaller neighbours are linked to the least of them
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        # dealt by both columns, so that the join deals it anew and a task with a large star can be split
        least = least.select("a", F.least("a", "low").alias("low")).repartition("a", "low")
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        links = cut(stars(stars(links, True), False))
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


class _Block:
    """Sets of a block of candidates, with postings of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.owner = owner[order]

    def weights(self, sets: list[np.ndarray]) -> list[float]:
        """How central each set is: how often the block has its shingles, on average; of those the fuller ones."""
        often = np.diff(self.ends)
        return [float(np.mean(often[np.searchsorted(self.keys, s)])) * len(s) ** 0.5 for s in sets]

    def linked(self, members: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have at least the similarity with the given one, exactly."""
        at = np.minimum(np.searchsorted(self.keys, members), len(self.keys) - 1)
        at = at[self.keys[at] == members]
        if not len(at):
            return np.zeros(0, np.int64)
        spans = self.ends[at + 1] - self.ends[at]
        spot = np.repeat(self.ends[at] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        both = np.bincount(self.owner[spot], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(members) - both))


def resolve(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least id of each set's component under exact similarity.

    A set is compared with all others at once. Only sets outside the largest component need comparing: two sets of
    different components are then never both uncompared. It begins with the set whose shingles the block has most often.
    Sets left out for a component that is not the largest in the end are compared after all.
    """
    block, n = _Block(sets), len(sets)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    weight = block.weights(sets)
    waiting = sorted(range(n), key=lambda i: -weight[i])
    size = np.ones(n, np.int64)
    largest = None
    while waiting:
        spared = []
        for i in waiting:
            if largest is not None and top(i) == top(largest):
                spared.append(i)
                continue
            for j in block.linked(sets[i], percent):
                a, b = top(i), top(int(j))
                if a != b:
                    a, b = (a, b) if size[a] >= size[b] else (b, a)
                    root[b] = a
                    size[a] += size[b]
            if largest is None or size[top(i)] > size[top(largest)]:
                largest = i
        # all that were spared must lie in one component; another round compares those of the others
        waiting = spared if any(top(i) != top(largest) for i in spared) else []
    tops = np.array([top(i) for i in range(n)], np.int64)
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, tops, ids)
    return low[tops]


def _sets_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _resolve_block(percent: int, table: pa.Table) -> pa.Table:
    alone("near duplicates")
    ids = table["doc_id"].to_numpy()
    return pa.table({"a": pa.array(ids), "b": pa.array(resolve(ids, _sets_of(table["shingles"]), percent))})


def _shingle(words: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near duplicates")
        for batch in batches:
            for start, stop in slices(batch.column(2), 1 << 20):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(as_bytes(part.column(2)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["block", "doc_id", "shingles"])

    return shingled


def _pack(table: pa.Table) -> pa.Table:
    sets = table["shingles"].to_pylist()
    return pa.table({"block": table["block"].slice(0, 1), "piece": table["piece"].slice(0, 1), "ids": pa.array([table["doc_id"].to_numpy().tobytes()], pa.binary()), "sizes": pa.array([np.array([len(s) // 8 for s in sets], np.int64).tobytes()], pa.binary()), "shingles": pa.array([b"".join(sets)], pa.binary())})


def _unpack(row: dict, side: str = "") -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = np.frombuffer(row["sizes" + side], np.int64)
    return np.frombuffer(row["ids" + side], np.int64), np.split(np.frombuffer(row["shingles" + side], np.uint64), np.cumsum(sizes)[:-1])


def _compare_pieces(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, sets = _unpack(row)
            others, other_sets = _unpack(row, "_2")
            block, a, b = _Block(sets), [], []
            for other, members in zip(others, other_sets):
                linked = ids[block.linked(members, percent)]
                a.append(linked)
                b.append(np.full(len(linked), other))
            a, b = np.concatenate(a), np.concatenate(b)
            # a forest of the links says the same of components
            roots = _forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(roots[0]), pa.array(roots[1])], ["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            break
    return nodes, nodes[low]


def _large_blocks(members: DataFrame, percent: int, piece_shingles: int) -> DataFrame:
    """Links (a, b) of blocks too large for one task: their pieces are compared two by two, each pair of pieces a task's row.

    Pieces are compared within themselves first; what has met in the largest component so far needs no comparison with
    that component, so only pieces of the others (the residue) meet all pieces.
    """
    pieces = members.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("total") / piece_shingles)).cast("int"))
    packed = "block long, piece int, ids binary, sizes binary, shingles binary"
    one = cut(pieces.select("block", "piece", "doc_id", "shingles").groupBy("block", "piece").applyInArrow(_pack, packed))
    # a centre for each block: of each piece the most central set, then the one of the least piece
    within = cut(one.mapInArrow(partial(_within, percent), "block long, a long, b long, centre long"))
    centre = within.groupBy("block").agg(F.min("centre").alias("centre"))
    sets = pieces.select("block", "doc_id", "shingles")
    chosen = sets.join(centre.withColumnRenamed("centre", "doc_id"), ["block", "doc_id"]).select("block", F.col("doc_id").alias("centre"), F.col("shingles").alias("middle"))
    near = one.join(chosen, "block").mapInArrow(partial(_near_centre, percent), "a long, b long")
    links = within.select("a", "b").unionByName(near)
    parts = connected_components(links)
    placed = sets.select("block", "doc_id").join(parts, F.col("doc_id") == F.col("id"), "left").select("block", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    sizes = placed.groupBy("block", "root").count()
    largest = sizes.groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    rest = placed.join(largest, "block").where("root <> largest").select("block", "doc_id")
    residue = pieces.select("block", "piece", "doc_id", "shingles").join(rest, ["block", "doc_id"]).groupBy("block", "piece").applyInArrow(_pack, packed)
    pairs = one.join(residue.select("block", *[F.col(c).alias(f"{c}_2") for c in ("ids", "sizes", "shingles")]), "block")
    crossed = pairs.select("ids", "sizes", "shingles", "ids_2", "sizes_2", "shingles_2").mapInArrow(partial(_compare_pieces, percent), "a long, b long")
    return links.unionByName(crossed)


def _within(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, sets = _unpack(row)
            roots = resolve(ids, sets, percent)
            centre = ids[int(np.argmax(_Block(sets).weights(sets)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(ids), pa.array(roots), pa.array(np.full(len(ids), centre))], ["block", "a", "b", "centre"])


def _near_centre(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, sets = _unpack(row)
            linked = ids[_Block(sets).linked(np.frombuffer(row["middle"], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(np.full(len(linked), row["centre"]))], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, seed: int = SEED, block_shingles: int = BLOCK_SHINGLES, piece_shingles: int = PIECE_SHINGLES, piece_members: int = PIECE_MEMBERS) -> DataFrame:
    """Components of documents linked by the similarity of their shingle sets.

    Returns doc_id, n_shingles, component_id, kept. Documents are linked if 100 * intersection >= `percent` * union of
    their sets of distinct shingles (`words` words; a shorter text is one shingle). Minima of bands * rows universal
    hashes are taken of each set; sets that share a band are candidates. Equal sets are one class from the start, so a
    thousand copies are one candidate. Candidates are verified on their signatures: by verified_links(), with the least of
    their band, and only those that don't agree with it with the others. Large-star and small-star steps make blocks of
    what agrees; no link leaves a block. In its block every set is compared exactly, on full sets, as far as components
    can depend on it: in one task up to `block_shingles` shingles, beyond that in pieces that meet each other. The same
    steps make components of the links that this confirms. Only texts with a verified candidate are shuffled.

    Documents without words or with null text have no shingles and are linked with nothing, not with each other either.
    Ties: rows that repeat a doc_id each get their row; one of equal texts has the id's component, one of another text
    that of its own set.
    Null doc_ids are left out. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_parquet(plain.mapInArrow(_sign(words, bands, rows, seed), "doc_id long, n_shingles long, same binary, bands array<long>, minima binary"))
    full = signed.where("same is not null")
    classes = cut(full.groupBy("same").agg(F.min("doc_id").alias("first")))  # read twice, and joins with a table are split where copies are many
    firsts = full.join(classes, "same").where("doc_id = first").select("doc_id", "n_shingles", "bands", "minima")
    links = verified_links(firsts, bands * rows, percent, piece_members=piece_members)
    blocks = cut(connected_components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("block")))
    sized = firsts.select("doc_id").join(blocks, "doc_id")
    members = plain.join(sized.select("doc_id", "block").distinct(), "doc_id").select("block", "doc_id", "text").mapInArrow(_shingle(words), "block long, doc_id long, shingles binary")
    members = cut_parquet(members)
    totals = members.groupBy("block").agg(F.sum(F.octet_length("shingles") / 8).cast("long").alias("total"))
    dealt = members.join(totals, "block")
    small = dealt.where(F.col("total") <= block_shingles).groupBy("block").applyInArrow(lambda table: _resolve_block(percent, table), "a long, b long")
    links = small
    if not totals.where(F.col("total") > block_shingles).isEmpty():
        links = links.unionByName(_large_blocks(dealt.where(F.col("total") > block_shingles), percent, piece_shingles))
    parts = connected_components(links).select(F.col("id").alias("first"), F.col("root"))
    firsts_root = cut(classes.join(parts, "first", "left").select("same", F.coalesce("root", "first").alias("root")))
    out = signed.select("doc_id", "n_shingles", "same").join(firsts_root, "same", "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def op5_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4)
