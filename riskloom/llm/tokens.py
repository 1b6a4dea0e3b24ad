"""Words and shingles of a text as 64-bit hashes, vectorised over its bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random value per byte; a word's hash is their sum weighted by powers of an odd number, then mixed.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, step: np.uint64 = STEP) -> np.ndarray:
    out = np.full(n, step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)
_PLACE = powers(64, np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in a text's bytes."""
    a = LOWER[text]
    inside = ~SPACE[a]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(first):
        return np.empty(0, dtype=np.uint64), first
    a = a[inside]
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(a)) - np.repeat(begin, lengths)
    longest = int(lengths.max())
    weight = (_POWERS if longest <= len(_POWERS) else powers(longest))[place]
    return mix(np.add.reduceat(BYTE[a] * weight, begin) + lengths.astype(np.uint64)), first


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, split at spaces and the controls 9 to 13."""
    return _words(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))[0]


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of all its words if there are fewer; empty without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(k, len(w))
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * _PLACE[j + 1]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of shingle_set() of several texts one after the other, their sizes, and the numbers of the texts' words."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    w, starts = _words(np.frombuffer(b" ".join(encoded), dtype=np.uint8))
    ends = np.cumsum([len(e) + 1 for e in encoded])
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(w):
        return w, np.zeros(len(texts), dtype=np.int64), n_words
    first = np.cumsum(n_words) - n_words
    counts = np.where(n_words > 0, np.maximum(n_words - k, 0) + 1, 0)
    at = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), dtype=np.uint64)
    for n in np.unique(np.minimum(n_words, k)).tolist():
        some = np.flatnonzero(np.minimum(n_words, k) == n)
        if n:
            inner = np.arange(counts[some].sum()) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
            total = np.full(len(w) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                total += w[j : len(w) - n + 1 + j] * _PLACE[j + 1]
            out[np.repeat(at[some], counts[some]) + inner] = mix(total[np.repeat(first[some], counts[some]) + inner])
    for s, n in zip(at.tolist(), counts.tolist(), strict=True):
        out[s : s + n].sort()
    new = np.append(True, out[1:] != out[:-1])
    new[at[counts > 0]] = True
    sizes = np.diff(np.append(0, np.cumsum(new))[np.append(at, len(out))])
    return out[new], sizes, n_words
