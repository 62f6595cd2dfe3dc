"""Word shingles of whole texts as 64-bit hashes, computed with numpy for many texts at once.

Words are runs free of space and \\x09-\\x0D, with A-Z lower-cased.  A text's set holds its distinct shingles
of five words; with one to four words, the whole sequence as one; without words, nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text hashed together.
CHUNK = 1 << 20
_M64 = (1 << 64) - 1


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _odd(101, 256)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = _odd(102, WIDTH)
_LENGTH = _odd(103, WIDTH + 1)
_BASE = int(_odd(104, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and its inverse modulo 2^64, grown as texts need."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's begin (with the end at last)."""
    data = b" " + b" ".join(texts) + b" "
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers.upto(len(codes))
    values = _VALUE[codes]
    values *= up
    np.cumsum(values, out=values)
    words = mix((values[ends - 1] - values[starts - 1]) * down[starts])
    edges = np.cumsum([1, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, edges)
    counts = np.diff(first)
    n = len(words)
    if n >= WIDTH:
        total = words[: n - WIDTH + 1] * _PLACE[0]
        for k in range(1, WIDTH):
            total += words[k : n - WIDTH + 1 + k] * _PLACE[k]
        full = mix(total + _LENGTH[WIDTH])
    else:
        full = np.zeros(0, np.uint64)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if len(full) == at[-1] and len(texts) == 1:
        return full, at
    out = np.zeros(at[-1], np.uint64)
    for d in range(len(texts)):
        if counts[d] >= WIDTH:
            out[at[d] : at[d + 1]] = full[first[d] : first[d] + sizes[d]]
        elif counts[d]:
            own = words[first[d] : first[d + 1]]
            out[at[d]] = mix((own * _PLACE[: counts[d]]).sum(keepdims=True) + _LENGTH[counts[d]])[0]
    return out, at


def sequences(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Each text's shingle hashes in order of place, repeats kept."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        out, at = _hashed(held)
        for d in range(len(held)):
            yield out[at[d] : at[d + 1]]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield from flush()
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield from flush()


def sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for s in sequences(texts):
        yield np.unique(s)


def multipliers(k: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return _odd(seed, k)


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``k`` permutations of 32-bit numbers."""
    return _odd(seed, k).astype(np.uint32) | np.uint32(1), (_odd(seed + 1, k) >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the hashes' upper 32 bits; long sets are taken in blocks."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        values = np.multiply.outer(mul, short[i : i + 2048])
        values += add[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low.astype(np.uint64)
