"""Words and shingles of texts as 64-bit hashes, by numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse mod 2^64
#: Bytes that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, mod 2^64."""
    return chunk_powers() if n <= CHUNK else _powers(n)


@lru_cache(maxsize=1)
def chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of some texts: their bytes, each word's start, end and hash, and the number of words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    #: where each text's bytes begin, and one past the last text's end
    at: np.ndarray


def words_of(part: list[bytes]) -> Words:
    """Words lie between white space. A word's hash is the difference of running sums of byte value * BASE^position at its
    ends, shifted back to position 0."""
    data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate((np.zeros(1, edges.dtype), edges))
    starts, ends = edges[0::2], edges[1::2]  # the last byte is blank, so each start has its end
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
    return Words(data, starts, ends, hashes, np.diff(np.searchsorted(starts, at)), at)


def hashed_words(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words between white space, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for part in chunks(texts):
        found = words_of(part)
        out += np.split(found.hashes, np.cumsum(found.counts)[:-1])
    return out


def chunks(texts: list[str | None], lower: bool = True) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        data = (t or "").encode()
        data = data.lower() if lower else data
        if part and size + len(data) + 1 > CHUNK:
            yield part
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        yield part


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words: a polynomial in an odd multiplier, mod 2^64, mixed once."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + hashes[k : k + count]
    return out ^ (out >> np.uint64(29))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `size` words; of fewer words, the whole sequence as one; without words, none."""
    return [
        rolled(h, len(h)) * MULTIPLIER + np.uint64(len(h)) if 0 < len(h) < size else distinct(rolled(h, size))
        for h in hashed_words(texts)
    ]
