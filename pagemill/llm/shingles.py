"""Word shingles as sorted arrays of 63-bit hashes, the shared ground of set similarity."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words remembered per task; the memory is emptied beyond this, so that a task's memory stays bounded.
WORDS_REMEMBERED = 200_000


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: Bytes of one step of hashing; the work arrays of a long text stay at eight times this.
STEP_BYTES = 1 << 16
#: Base of the positional hash of a word's bytes (odd, so that it has an inverse modulo 2**64), and one value a byte.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


POWERS = _powers(BASE, STEP_BYTES)
INVERSES = _powers(pow(BASE, -1, 1 << 64), STEP_BYTES)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, in UTF-8 with A-Z lowered (``bytes`` methods know ASCII only).

    A word's hash is the sum of its byte values times powers of a base, so it comes from the running
    sum at both of its ends.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8) if text else np.empty(0, np.uint8)
    blank = SPACE[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        # Words up to the step's end, and one at least: a word longer than a step gets powers of its own.
        origin = int(starts[first])
        last = max(int(np.searchsorted(ends, origin + STEP_BYTES, "right")), first + 1)
        size = int(ends[last - 1]) - origin
        powers = POWERS[:size] if size <= STEP_BYTES else _powers(BASE, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[origin : origin + size]] * powers, out=sums[1:])
        a = starts[first:last] - origin
        out[first:last] = (sums[ends[first:last] - origin] - sums[a]) * INVERSES[a]
        first = last
    return mixed(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words.

    A text with fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.int64)
    width = min(width, len(words))
    factors = _powers(BASE, width + 1)
    count = len(words) - width + 1
    rolled = words[:count] * factors[1] + np.uint64(width)
    for i in range(1, width):
        rolled += words[i : count + i] * factors[i + 1]
    found = np.sort((mixed(rolled) >> np.uint64(1)).astype(np.int64))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
