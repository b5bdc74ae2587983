"""Words and word shingles of whole texts as 64-bit hashes, computed over the bytes of a batch at once."""

from __future__ import annotations

import numpy as np

from boardwalk.llm import native

_RANDOM = np.random.RandomState(20240607)
_BYTE = _RANDOM.randint(1, 2**63 - 1, 256).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C55
_BACK = pow(_BASE, -1, 2**64)
_STEP = np.array([_RANDOM.randint(1, 2**62) * 2 + 1 for _ in range(64)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        grown = max(n, 1 << 20)
        tables = []
        for base in (_BASE, _BACK):
            steps = np.full(grown, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if n > 1 << 23:  # a single very long text; not kept
            return tables[0], tables[1]
        _POWERS["up"], _POWERS["down"] = tables
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and how many words each row has.

    ``gap`` says for each byte whether it is between words: by default words are ``[^\\x20\\x09-\\x0D]+``.
    """
    inside = ~gap[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)
    left = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends - 1] - left) * down[starts] + (ends - starts).astype(np.uint64))


def distinct(data: np.ndarray, offsets: np.ndarray, code: bytes) -> tuple[np.ndarray, ...]:
    """Words a row; the hashes of the different words, in order, and the start and end of each; and which of them each
    word is. ``code``: the compiled loops, if there are any."""
    loaded = native.library(code)
    if loaded is None:
        starts, ends, counts = spans(data, offsets)
        kinds, first, back = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        return counts, kinds, starts[first], ends[first], back
    counts, kinds, starts, ends, back = native.distinct(loaded, data, offsets, SPACE, _BYTE, _BASE)
    order = np.argsort(kinds)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return counts, kinds[order], starts[order], ends[order], place[back]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows one after the other, and the number of each row."""
    starts, ends, counts = spans(data, offsets, gap)
    return hashes(data, starts, ends), counts


def shingles(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, in order, and how many each row has.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    size = max(0, len(flat) - k + 1)
    total = np.zeros(len(flat), np.uint64)
    for j in range(k):
        total[:size] += flat[j : j + size] * _STEP[j]
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    found = mix(total[at] + np.uint64(k))
    short = np.flatnonzero((counts > 0) & (counts < k))
    place = np.cumsum(runs) - runs
    for i in short.tolist():
        n = int(counts[i])
        own = (flat[first[i] : first[i] + n] * _STEP[:n]).sum(dtype=np.uint64)
        found[place[i]] = mix(np.array([own], np.uint64) + np.uint64(n))[0]
    return found, runs


def shingle_rows(flat: np.ndarray, counts: np.ndarray, k: int):
    """The distinct shingle hashes of each row, sorted."""
    found, runs = shingles(flat, counts, k)
    at = 0
    for n in runs.tolist():
        row = found[at : at + n]
        at += n
        row.sort()
        if n > 1:
            new = np.empty(n, bool)
            new[0] = True
            np.not_equal(row[1:], row[:-1], out=new[1:])
            row = row[new]
        yield row
