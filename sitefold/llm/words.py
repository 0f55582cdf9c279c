"""Words of whole texts in numpy: borders, hashes and rolling hashes for a batch of documents at once.

A batch is the bytes of many texts without separators and the offsets of the texts in it. Word borders come from a
table of word bytes, so that nothing here loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; one larger text is handled alone.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_class(excluded: str) -> np.ndarray:
    """256 booleans: True for bytes of a word; ``excluded`` holds the other bytes, all below 0x80."""
    member = np.ones(256, dtype=bool)
    member[[ord(c) for c in excluded]] = False
    return member


#: Words ``[^\x20\x09-\x0D]+`` and words of letters and digits ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
NOT_BLANK = byte_class(" \t\n\x0b\x0c\r")
ALPHANUMERIC = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents that hold about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (and one past the last)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = member[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]  # empty texts have no first byte
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = inside.copy()
    after[begins] = False
    ends = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit changes about half of the output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes of every span at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    h = lengths.astype(np.uint64) * _MULTIPLIER
    alive, at, left, part = slice(None), starts, lengths, h
    while len(at):
        part = mixed(part ^ (eight[at] & _TAIL[np.minimum(left, 8)])) * _MULTIPLIER
        h[alive] = part
        more = np.flatnonzero(left > 8)
        alive = more if isinstance(alive, slice) else alive[more]
        at, left, part = at[more] + 8, left[more] - 8, part[more]
    return mixed(h)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        _POWERS[base] = known
    return known[:n]


def rolling_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all windows of ``width`` consecutive word hashes.

    With prefix sums P of h[j] * base**j, a window's polynomial is (P[i + width] - P[i]) * base**-i; ``base`` is odd.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(base, n), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[width:] - sums[: n + 1 - width]) * _powers(inverse, n + 1 - width))


def window_mask(first_word: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which of the windows over all words of a batch stay within one document."""
    if n_words < width:
        return np.zeros(0, bool)
    document_end = np.repeat(first_word[1:], np.diff(first_word))
    return np.arange(n_words - width + 1) + width <= document_end[: n_words - width + 1]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    starts = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(starts, counts)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest width that holds them; the first byte tells it."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.uint64)
