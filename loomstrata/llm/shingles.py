"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A word's hash is a polynomial over its UTF-8 bytes (through a table
of random odd numbers), read off one running sum for the whole buffer, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62)) * 8 + 5
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n, _BASE, np.uint64))
            down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
        _powers.update(n=n, up=up, down=down)
    return _powers["up"], _powers["down"]


def word_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text k are hashes[offsets[k]:offsets[k + 1]]."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    up, down = _power(len(raw))
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
        hashes = mix((run[end] - run[begin]) * down[begin])
    stop = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.concatenate([[0], np.searchsorted(begin, stop)]).astype(np.int64)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    with np.errstate(over="ignore"):
        total = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            total = total + words[j : len(words) - k + 1 + j] * _PLACE[j]
    return mix(total + np.uint64(k))


def shingle_sets(texts: Iterable[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the distinct shingles of text i, in ascending order, are values[offsets[i]:offsets[i + 1]].
    A text of fewer than k words has its whole sequence as its one shingle; a text without words has none."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(size)])
    values = np.zeros(out[-1], np.uint64)
    if len(words) >= k:
        every = combine(words, k)
        place = np.arange(out[-1]) - np.repeat(out[:-1], size) + np.repeat(at[:-1], size)
        full = np.repeat(count >= k, size)
        values[full] = every[place[full]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        values[out[i]] = combine(words[at[i] : at[i + 1]], int(count[i]))[0]
    for i in np.flatnonzero(size > 1):
        values[out[i] : out[i + 1]].sort()
    if not len(values):
        return values, out
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    starts = out[:-1][size > 0]
    first[starts] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return values[first], kept[out]


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as two columns: equal sets have equal keys, others different ones but for chance."""
    keys = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for c, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            with np.errstate(over="ignore"):
                keys[full, c] = np.add.reduceat(mix(values + np.uint64(salt)), offsets[:-1][full])
    return keys


def chunks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about most characters each; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
