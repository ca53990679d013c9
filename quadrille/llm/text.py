"""Words and their 64-bit hashes, computed for whole Arrow columns with numpy.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64, passed through a finaliser.
It depends on the word's bytes alone, so equal words have equal hashes on every executor.  Work arrays are bounded
by ``CHUNK`` bytes of text at a time (or by one word, if that is longer), however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_rng = np.random.RandomState(20240117)
_VALUES = _rng.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are runs of anything but ASCII white space.
SPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Words are runs of digits, ASCII letters and everything beyond ASCII (after lower-casing A-Z).
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _table(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``n`` of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK + 1)
        known = np.ones(size, np.uint64)
        known[1:] = np.uint64(base)
        known = np.multiply.accumulate(known)
        if size <= 4 * CHUNK:
            _powers[base] = known
    return known


def spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where words start and end in it."""
    array = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(array) + 2, np.int8)
    inside[1:-1] = is_word[array]
    edge = np.diff(inside)
    return array, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_chunk(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of already lower-cased bytes."""
    array, starts, ends = spans(data, is_word)
    n = len(array)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[array] * _table(_BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _table(_BASE_INVERSE, n + 1)[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def _cut(data: bytes, is_word: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Pieces of about CHUNK bytes that end between words, with their offsets."""
    at, flags = 0, is_word.tobytes()
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and flags[data[end]] and flags[data[end - 1]]:
            end += 1
        yield at, data[at:end]
        at = end


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hashed_words(texts: list[bytes | None], is_word: np.ndarray = SPACED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bounds, hashes)`` for consecutive runs of texts.

    Text ``first + k`` has the words ``hashes[bounds[k]:bounds[k + 1]]``, ``k < last - first``; a null text has none.
    A-Z are lower-cased.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last] or b"") + 1 <= CHUNK):
            size += len(texts[last] or b"") + 1
            last += 1
        run = [(t or b"").translate(LOWER_AZ) for t in texts[first:last]]
        if len(run) == 1:
            parts = [hash_chunk(piece, is_word)[2] for _, piece in _cut(run[0], is_word)]
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            bounds = np.array([0, len(hashes)])
        else:
            starts, _, hashes = hash_chunk(b"\n".join(run), is_word)
            begin = np.cumsum([0] + [len(t) + 1 for t in run])
            bounds = np.searchsorted(starts, begin)
        yield first, last, bounds, hashes
        first = last
