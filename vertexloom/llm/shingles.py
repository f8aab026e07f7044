"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of documents.

Words are runs without space, tab, line feed, vertical tab, form feed or carriage return;
A-Z are lower-cased. A set holds the distinct hashes of `width` consecutive words; a text
with fewer words has its whole sequence as its one shingle; one without words has none.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_POWER = U(0x9E3779B97F4A7C15)
#: Bytes that are hashed at once, and places whose powers one table holds.
STEP, STRIDE = 1 << 20, 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the document of each. Bytes are hashed `STEP` at a time, within words too, so a long text takes little more than itself."""
    raw = [t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts  # the last byte is a line feed
    longest = int(lengths.max())
    low = np.multiply.accumulate(np.concatenate(([U(1)], np.full(min(longest, STRIDE) - 1, _POWER))))
    high = np.multiply.accumulate(np.concatenate(([U(1)], np.repeat(low[-1:] * _POWER, longest // STRIDE))))
    sums = np.zeros(len(starts), np.uint64)
    for s in range(0, len(data), STEP):
        some = inside[s : s + STEP]
        at = np.flatnonzero(some) + s
        if len(at):
            word = np.searchsorted(starts, s) - 1 + np.cumsum(begin[s : s + STEP])[some]
            place = at - starts[word]
            value = _BYTE[_LOWER[data[at]]] * low[place % STRIDE] * high[place // STRIDE]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sums[word[first]] += np.add.reduceat(value, first)
    return mix(sums ^ mix(lengths.astype(np.uint64))), np.searchsorted(begins, starts, side="right") - 1


def shingle_sets(texts: list[str] | list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by document and hash, and the document of each."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    n = len(words)
    full = np.zeros(0, np.uint64)
    docs = np.zeros(0, np.int64)
    if n >= width:
        whole = owner[: n - width + 1] == owner[width - 1 :]
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total += words[k : n - width + 1 + k] * _PLACE[k]
        full, docs = mix(total[whole]), owner[: n - width + 1][whole]
    short = (counts > 0) & (counts < width)
    if short.any():
        of = short[owner]
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        place = np.arange(n)[of] - first[owner[of]]
        value = words[of] * _PLACE[place]
        own = owner[of]
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        full = np.concatenate((full, mix(np.add.reduceat(value, begin) + U(0x51ED270B) * counts[own[begin]].astype(np.uint64))))
        docs = np.concatenate((docs, own[begin]))
    order = np.lexsort((full, docs))
    full, docs = full[order], docs[order]
    fresh = np.ones(len(full), bool)
    fresh[1:] = (full[1:] != full[:-1]) | (docs[1:] != docs[:-1])
    return full[fresh], docs[fresh]
