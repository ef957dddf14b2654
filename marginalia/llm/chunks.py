"""Texts as chunks that a byte-level tokenizer encodes independently, each distinct chunk once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np

#: Distinct chunks that a worker keeps before it drops the later half of them; those that were met first are the most frequent.
KEPT_CHUNKS = 800_000
#: A space after something that is no white space always begins a token.
_SURE = re.compile(r"(?<=\S)(?= )")


class Numbered(dict):
    """Numbers of keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class ChunkTable:
    """Ids of distinct chunks, filled by `encode`, a function from strings to (flat ids, ids of each).

    The tokenizers' pattern lets a token hold a space only as its first character or amid white space, and a line end only
    amid white space. So a text may be cut before every space and line end, unless white space precedes it and white
    space or the end follows; a text with such a place is cut only at spaces after what is no white space. encode is also
    told of which strings the only white space is the one character that they begin with.
    """

    def __init__(self, encode: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_CHUNKS):
        self.encode, self.kept = encode, kept
        self.clear()

    def clear(self) -> None:
        self.known = Numbered()  # by what follows the space, or from the line end on; a chunk without either is in a tuple
        self.count = 0
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.unsure = np.zeros(0, bool)
        self.decoded: list[bytes] = []  # of the first chunks, for callers that decode; goes with them

    def halve(self) -> None:
        n = self.count // 2
        self.known, self.count = Numbered(islice(self.known.items(), n)), n
        self.ids = self.ids[: int(self.starts[n])].copy()
        self.starts, self.sizes, self.unsure = self.starts[:n].copy(), self.sizes[:n].copy(), self.unsure[:n].copy()
        del self.decoded[n:]

    def _fill(self) -> None:
        """Encode the chunks that have got numbers since the last time."""
        new = list(islice(reversed(self.known), len(self.known) - self.count))[::-1]
        if not new:
            return
        plain = [type(x) is tuple for x in new]
        rest = [x[0] if p else x[1:] if x[:1] == "\n" else x for x, p in zip(new, plain)]
        texts = [x[0] if p else x if x[:1] == "\n" else " " + x for x, p in zip(new, plain)]
        flat, sizes = self.encode(texts, [not p and x != "" and x.strip() is x for x, p in zip(rest, plain)])
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids = np.append(self.ids, flat.astype(np.uint32))
        self.sizes = np.append(self.sizes, sizes)
        self.unsure = np.append(self.unsure, [not p and (x == "" or x[0].isspace()) for x, p in zip(rest, plain)])
        self.count = len(self.known)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks, in order."""
        if self.count > self.kept:
            self.halve()
        number, found = self.known.__getitem__, []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            parts[0] = (parts[0],)
            found.append(np.array([*map(number, parts if parts[0] != ("",) else parts[1:])], np.int64))
        self._fill()
        if self.unsure.any():
            for i, x in enumerate(found):
                if len(x) and self.unsure[x].any():
                    found[i] = np.array([number((part,)) for part in _SURE.split(texts[i])], np.int64)
            self._fill()
        return found

    def gather(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text)."""
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[every] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        last = np.cumsum([len(x) for x in numbers])
        total = np.append(0, ends)[last] if len(numbers) else np.zeros(0, np.int64)
        return self.ids[at], np.diff(np.append(0, total))
