"""Words and hashes of many texts at once, in numpy, for use inside Arrow batches.

Words are runs of bytes other than the ASCII space and 0x09-0x0D, after lower-casing A-Z.
Hashes are 64-bit: prefix sums of (random value of each byte) * B^position modulo 2^64, from
which the hash of any substring follows by one subtraction and one product.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the longest n so far, if that is modest."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 1 << 23:
        _powers[base] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H of length n + 1: H[j] - H[i] is the hash of data[i:j] times BASE^i."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal substrings have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """substring_hashes of every run of `gram` values."""
    out = prefix[gram:] - prefix[:-gram]
    out *= powers(INVERSE, len(prefix))[: len(out)]
    out += U(gram)
    return mix(out)


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]


def blocks(parts: list[bytes], limit: int = 1 << 21):
    """(first, last) runs of parts with about `limit` bytes, one part at least."""
    first = total = 0
    for i, part in enumerate(parts):
        if i > first and total + len(part) > limit:
            yield first, i
            first, total = i, 0
        total += len(part)
    if parts:
        yield first, len(parts)


def word_spans(parts: list[bytes], gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all parts with a space between; starts and ends of words; first word of each part."""
    data = LOWER[np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)]
    word = ~gap[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    return data, starts, ends, np.searchsorted(starts, begins)


def word_hashes(parts: list[bytes], gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all parts, and the first word of each part (and the end)."""
    data, starts, ends, firsts = word_spans(parts, gap)
    return substring_hashes(prefix_hashes(data), starts, ends), firsts


SHINGLE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def shingle_sets(parts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each part's shingles of `width` words; with fewer words, of them all."""
    words, firsts = word_hashes(parts)
    n = len(words)
    run = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        run += words[k : n - width + 1 + k] * SHINGLE[k]
    run = mix(run)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            few = (words[a:b] * SHINGLE[width : width + b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
