"""Word hashes of a text in numpy, alike in every process."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = _powers(BASE)
INVERSE = _powers(pow(BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(b) > CHUNK:  # one word longer than a chunk
        out = np.uint64(0)
        for s in range(0, len(b), CHUNK):
            part = b[s : s + CHUNK].astype(np.uint64) + np.uint64(1)
            out = mix(np.array([out + (part * POWER[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
        return np.array([out], np.uint64)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * POWER[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * INVERSE[starts])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z taken as a-z. Words are what ASCII white space separates."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= CHUNK:
        return _chunk_hashes(np.frombuffer(raw, np.uint8))
    parts, at = [], 0
    b = np.frombuffer(raw, np.uint8)
    while at < len(b):
        end = min(at + CHUNK, len(b))
        if end < len(b):
            gaps = np.flatnonzero(_SPACE[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(more[0]) if len(more) else len(b)
        parts.append(_chunk_hashes(b[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of all words at once if there are fewer; none for none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + words[i : len(words) - k + 1 + i])
    return np.unique(out)
