"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, documents, hold, slices

#: Expected counts added to each piece, and scores are as sure as so many words can make them.
PRIOR = 0.1
SURE_WORDS = 20
#: Words that a worker keeps, bytes of the words that are scored at once, and positions after which sums are brought near 1.
KEPT_WORDS = 150_000
AT_ONCE = 1 << 17
STEP = 12
#: Bytes of the longest run of a word: a longer word is cut into runs of so many bytes at most, between characters.
LONG_WORD = 128
#: Languages that a model may have: a bound of what driver and tasks hold, which is a number a piece and language.
LANGUAGES = 200

#: ASCII that is no letter separates words.
_APART = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """The pieces of a rank file, of any length, without leading blanks, in lower case; with every single byte they cover any text.

    They are found as a trie, level by level: of all places of many words at once, those go on that still begin a piece.
    """

    def __init__(self, path: str):
        ranked = [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines()]
        own = {p.strip(b" ") for p in ranked}
        own = {p for p in own if p and p == p.translate(_APART) and p.decode("utf-8", "replace") == p.decode("utf-8", "replace").lower()}
        self.pieces = sorted(own | {bytes([c]) for c in range(256)})
        nodes: dict[bytes, int] = {bytes([c]): c for c in range(256)}
        steps = []
        for p in self.pieces:
            for n in range(2, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    steps.append((nodes[p[: n - 1]] << 8 | p[n - 1], nodes[p[:n]]))
        self.piece = np.full(len(nodes), -1, np.int64)
        for i, p in enumerate(self.pieces):
            self.piece[nodes[p]] = i
        keys, following = np.array(steps, np.int64).reshape(-1, 2).T
        # steps from a node by a byte: a table of slots, with the steps of one slot in a row
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.following = np.append(keys[order], -1), np.append(following[order], -1)
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))
        self.crowd = int(np.diff(self.first).max(initial=0))

    def __len__(self) -> int:
        return len(self.pieces)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at, stop = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        rows = np.flatnonzero(at < stop)
        for _ in range(self.crowd):
            if not len(rows):
                break
            hit = self.keys[at[rows]] == keys[rows]
            out[rows[hit]] = self.following[at[rows[hit]]]
            rows = rows[~hit]
            at[rows] += 1
            rows = rows[at[rows] < stop[rows]]
        return out

    def found(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: (places, pieces) in words of one size; place = start * len(words) + word, ascending."""
        n, size = len(words), len(words[0])
        grid = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).T.reshape(-1).astype(np.int64)
        place, node = np.arange(n * size), grid
        out = [(place, self.piece[node])]
        for m in range(2, size + 1):
            inside = place < n * (size - m + 1)
            place = place[inside]
            node = self._next(node[inside] << 8 | grid[place + n * (m - 1)])
            place, node = place[node >= 0], node[node >= 0]
            if not len(place):
                break
            whole = self.piece[node] >= 0
            out.append((place[whole], self.piece[node[whole]]))
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def forward(found: list[tuple[np.ndarray, np.ndarray]], n: int, size: int, weights: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of what precedes (with back: follows) each position: [position, word, language], and powers of 2.

    found: the pieces of `n` words of `size` bytes; weights: [piece, language].
    """
    sums = np.zeros((size + 1, n, weights.shape[1]))
    power = np.zeros((size + 1, n), np.int64)
    sums[size if back else 0] = 1
    edges = [np.searchsorted(place, np.arange(0, n * (size + 1) + 1, n)) for place, _ in found]
    for i in range(1, size + 1):
        to = size - i if back else i
        power[to] = power[to + 1 if back else to - 1]
        for m in range(1, min(i, len(found)) + 1):
            start, come = (to, to + m) if back else (to - m, to - m)
            a, b = edges[m - 1][start], edges[m - 1][start + 1]
            if a == b:
                continue
            row = found[m - 1][0][a:b] - start * n
            part = weights[found[m - 1][1][a:b]] * sums[come, row]
            if (i - 1) // STEP > (i - m) // STEP:  # sums were brought near 1 in between
                part *= np.exp2((power[come] - power[to])[row].astype(float))[:, None]
            sums[to, row] += part
        if i % STEP == 0:
            exponent = np.frexp(sums[to].max(1))[1]
            sums[to] = np.ldexp(sums[to], -exponent[:, None])
            power[to] += exponent
    return sums, power


def _runs(words: list[bytes]) -> Iterator[list[int]]:
    """Words of one size, so many that they have about AT_ONCE bytes."""
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for size, own in of.items():
        step = max(1, AT_ONCE // size)
        for a in range(0, len(own), step):
            yield own[a : a + step]


def _log_sums(pieces: Pieces, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log probability of each word under each language, over all its segmentations."""
    out = np.zeros((len(words), weights.shape[1]))
    for at in _runs(words):
        some = [words[i] for i in at]
        sums, power = forward(pieces.found(some), len(some), len(some[0]), weights)
        out[at] = np.log(np.maximum(sums[-1], 1e-300)) + power[-1][:, None] * np.log(2)
    return out


def _expected(pieces: Pieces, weights: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """Expected counts of each piece over all segmentations of the words under one weighting; times: [word, language]."""
    total = np.zeros((len(pieces), times.shape[1]))
    for at in _runs(words):
        some = [words[i] for i in at]
        n, size = len(some), len(some[0])
        found, often = pieces.found(some), times[at]
        (ahead, up), (behind, down) = (forward(found, n, size, weights, back) for back in (False, True))
        whole, whole_up = ahead[-1, :, 0], up[-1]
        ahead, up, behind, down = (x.reshape(-1) for x in (ahead, up, behind, down))
        for m, (place, piece) in enumerate(found, 1):
            word = place % n
            share = ahead[place] * weights[piece, 0] * behind[place + m * n] / whole[word]
            if size >= STEP:
                share *= np.exp2((up[place] + down[place + m * n] - whole_up[word]).astype(float))
            for k in range(times.shape[1]):
                total[:, k] += np.bincount(piece, weights=share * often[word, k], minlength=len(total))
    return total


def _cut(word: bytes) -> Iterator[bytes]:
    start = 0
    while len(word) - start > LONG_WORD:
        stop = start + LONG_WORD
        while word[stop] & 0xC0 == 0x80:  # within a character
            stop -= 1
        yield word[start:stop]
        start = stop
    yield word[start:]


def _words(text: str) -> list[bytes]:
    """What lies between ASCII characters that are no letters, in lower case; a long word as runs, side by side, so that scripts
    without blanks take time in proportion to the text and memory to the run."""
    words = text.lower().encode("utf-8", "replace").translate(_APART).split()
    if max(map(len, words), default=0) > LONG_WORD:
        return [run for w in words for run in _cut(w)]
    return words


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _prior_weights(pieces: Pieces) -> np.ndarray:
    """Before any text is seen, a piece of n bytes weighs 40 ** -(1 + (n - 1) / 2): more than its bytes apart, less than a single one."""
    return np.array([[40.0 ** -(1 + 0.5 * (len(p) - 1))] for p in pieces.pieces])


def _learn(path: str):
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("languages")
        pieces = pieces_of(path)
        weights = _prior_weights(pieces)
        seen: dict[str, dict[bytes, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            words = list({w for own in seen.values() for w in own})
            langs = sorted(seen)
            times = np.array([[seen[k].get(w, 0) for k in langs] for w in words], float).reshape(len(words), len(langs))
            for k, column in zip(langs, _expected(pieces, weights, words, times).T):
                sums[k] = sums.get(k, 0) + column
            seen.clear()

        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = seen.setdefault(lang, {})
                    for w in _words(text):
                        own[w] = own.get(w, 0) + 1
                    if sum(map(len, seen.values())) > KEPT_WORDS:
                        settle()
                if len(sums) + len(seen) > LANGUAGES:
                    raise ValueError(f"more than {LANGUAGES} languages")
        if seen:
            settle()
        for lang, column in sums.items():
            used = np.flatnonzero(column > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(column[used])], ["lang", "piece", "expected"])

    return learned


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, log-linear weights [piece, language]) from the rows that are given.

    One step of expectation: every word's segmentations are weighted by a fixed prior over the vocabulary, and each
    language's expected counts of pieces become its piece probabilities. Tasks send a row for each language and piece
    that they saw, combined by a sum, so the driver gets (languages x vocabulary) rows, whatever the input. More than
    LANGUAGES languages fail the job, since a model holds a number for each piece and language.
    """
    path = path or vocabulary_path()
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = rows.mapInArrow(_learn(path), "lang string, piece long, expected double").groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.full((len(pieces_of(path)), len(langs)), PRIOR)
    of = {k: i for i, k in enumerate(langs)}
    np.add.at(counts, (found["piece"].to_numpy(), np.array([of[k] for k in found["lang"].to_pylist()], np.int64)), found["expected"].to_numpy())
    counts = np.round(counts, 6)  # the order of sums doesn't show
    return langs, counts / counts.sum(0)


class _Scores:
    """Log probabilities of the words that a worker has met: a row number for each word, and the rows."""

    def __init__(self, languages: int):
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((0, languages))

    def of(self, pieces: Pieces, weights: np.ndarray, lists: list[list[bytes]]) -> list[np.ndarray]:
        every = set().union(*lists)
        if len(self.number) > KEPT_WORDS:  # those that were met first are the most frequent
            self.number, self.rows = dict(islice(self.number.items(), KEPT_WORDS // 2)), self.rows[: KEPT_WORDS // 2]
        new = list(every.difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.rows = np.vstack([self.rows, _log_sums(pieces, weights, new)])
        return [self.rows[list(map(self.number.__getitem__, own))].sum(0) for own in lists]


_scores: dict[tuple, _Scores] = {}


def _judge(langs: list[str], weights: np.ndarray, path: str):
    """A function from texts to (languages, scores), which keeps the scores of words in its worker."""
    mark = (path, tuple(langs), zlib.crc32(weights.tobytes()))

    def judged(texts: list[str | None]) -> tuple[list[str], list[float]]:
        alone("languages")
        pieces = pieces_of(path)
        hold("languages", _scores.clear)
        if mark not in _scores:
            _scores.clear()
        known = _scores.setdefault(mark, _Scores(weights.shape[1]))
        lists = [_words(t or "") for t in texts]
        preds, scores = [], []
        for text, own, total in zip(texts, lists, known.of(pieces, weights, lists)):
            if not langs or not text or not _has_letter(text):
                preds.append("und")
                scores.append(0.0)
                continue
            chance = np.exp((total - total.max()) * min(1.0, SURE_WORDS / max(1, len(own))))
            preds.append(langs[int(np.argmax(chance))])
            scores.append(float(chance.max() / chance.sum()))
        return preds, scores

    return judged


def _predict(langs: list[str], weights: np.ndarray, path: str):
    judged = _judge(langs, weights, path)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                preds, scores = judged(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predicted


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, path: str | None = None) -> DataFrame:
    """The language of every document, learned from the documents whose crc32(id) mod `folds` is not `fold`.

    Returns doc_id, held_out, lang_pred, score. Words are what lies between ASCII characters that are no letters, in
    lower case; a word of over LONG_WORD bytes, as in scripts without blanks, counts as runs of so many bytes at most,
    cut between characters. A word's probability in a language is the sum over all its segmentations into pieces of a
    public vocabulary (forward algorithm); a text's is the product over its words. score is the share of the best language
    among all, as sure as SURE_WORDS words can make it.

    A null, empty or letterless text is `und` with score 0, and so is every text when no row has a language. A null
    language is not learned from. Ties go to the first language in code point order. Null ids hash as an empty string.
    Repeated rows each get their row; an empty table gives none. Other columns are ignored.
    """
    path = path or vocabulary_path()
    out = held_out(id_col, folds, fold)
    langs, weights = fit_languages(docs.where(~out), id_col, text_col, lang_col, path)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_predict(langs, weights, path), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, path: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with at least `least_score`.

    Predictions are those of identify_languages(). Rows are kept or dropped where they lie, without a shuffle. Null, empty
    and letterless texts go, as does every row when none has a language; repeated rows stay or go together.
    """
    path = path or vocabulary_path()
    langs, weights = fit_languages(docs.where(~held_out(id_col, folds, fold)), id_col, text_col, lang_col, path)
    judged, at = _judge(langs, weights, path), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                preds, scores = judged(part.column(at).to_pylist())
                yield part.filter(pa.array([p != "und" and s >= least_score for p, s in zip(preds, scores)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op9_language_id(spark, sf_dir) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
