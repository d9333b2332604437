"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts are joined into one byte buffer with a line end between them, so a
single pass over the bytes finds and hashes the words of a whole batch. Two
different words share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes hashed at a time; words are never cut
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, np.uint8)  # 1: part of a word
SPACES[:] = 1
SPACES[[32, 9, 10, 11, 12, 13]] = 0

RUNS = np.full(256, 2, np.uint8)  # 1: letter, digit or byte of a longer character; 2: other signs; 0: white space
RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
RUNS[[*range(0, 33)]] = 0

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_powers: dict[str, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 4096), base, np.uint64)
        known[0] = 1
        known = _powers[str(base)] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; sorting is far quicker here than hashing."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))] if len(values) else values


def spans(buf: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes of one class other than 0."""
    kind = classes[buf]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    if not len(edge):
        return edge, edge
    kind = np.append(kind, np.uint8(0))[edge[:-1]] if len(edge) > 1 else kind[:0]
    keep = kind != 0
    return edge[:-1][keep], edge[1:][keep]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the buffer, by its bytes alone."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _table(_BASE, len(buf)), out=total[1:])
    return mix((total[ends] - total[starts]) * _table(_INVERSE, len(buf) + 1)[starts])


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(buf):
        end = min(begin + PIECE, len(buf))
        while end < len(buf) and buf[end] != 10:
            step = np.flatnonzero(buf[end : end + PIECE] == 10)
            end = end + int(step[0]) if len(step) else min(end + PIECE, len(buf))
        yield begin, end
        begin = end


def portions(texts: Sequence[str | None], characters: int = PIECE) -> Iterator[Sequence[str | None]]:
    """The texts in order, in parts of about so many characters (a longer text is a part of its own)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and size + n > characters:
            yield texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield texts[begin:]


def give_back() -> None:
    """Return memory that is free to the system: idle workers stand beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def arrow_portions(texts: pa.Array, characters: int = PIECE) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of an Arrow column in order, in parts of about so many characters, with each part's first row."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + characters, "right")))
        yield begin, texts.slice(begin, end - begin).to_pylist()
        begin = end
    give_back()


def hashed_words(
    texts: Sequence[str | None], classes: np.ndarray = SPACES, lower: bool = True, stem: int = 0
) -> tuple[np.ndarray, ...]:
    """Hashes of all words, and for each text where its words begin (one more entry at the end).

    With ``stem`` also the hashes of the words' first ``stem`` bytes.
    """
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    if lower:
        buf = LOWER[buf]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    hashes, begins, stems = [], [], []
    for begin, end in _pieces(buf):
        s, e = spans(buf[begin:end], classes)
        hashes.append(span_hashes(buf[begin:end], s, e))
        begins.append(s + begin)
        if stem:
            stems.append(span_hashes(buf[begin:end], s, np.minimum(e, s + stem)))
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if stem:
        return words, np.searchsorted(starts, at), np.concatenate(stems) if stems else words
    return words, np.searchsorted(starts, at)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct ``size``-word shingles.

    A text of fewer words has its whole sequence as the only shingle, one
    without words the empty set.
    """
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            whole += words[k : k + len(whole)] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        whole = mix(whole)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            yield distinct(whole[a : b - size + 1])
        elif b > a:
            part = np.array([pow(_BASE, k + 1, 1 << 64) for k in range(b - a)], np.uint64)
            yield mix(np.array([(words[a:b] * part).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
