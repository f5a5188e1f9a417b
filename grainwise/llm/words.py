"""Words and word shingles of whole texts as 64-bit hashes, computed over byte arrays.

A word is a run of characters other than space and the controls 0x09 to 0x0D,
after lower-casing A to Z alone. Texts stay UTF-8 bytes: every separator is a
single byte that no multi-byte character contains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_random = np.random.default_rng(20240229)
_BYTE_VALUE = _random.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_PLACE_VALUE = _random.integers(1, 2**63, size=SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (a murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(4096)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each row begins; null rows are empty."""
    column = pa.array(column.fill_null(""), type=pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of one run of bytes; ``breaks`` are offsets where a word ends in any case."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    breaks = breaks[breaks < n]
    begins[breaks] = inside[breaks]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.empty(0, np.uint64), starts
    position = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if starts[0] == 0 else None
    if position is None:
        position = np.zeros(n, dtype=np.int64)
        position[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    longest = int(position.max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    value = _BYTE_VALUE[raw] * powers[position]
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), starts


def _split(raw: np.ndarray, limit: int) -> list[int]:
    """Cut points of one long text, each at a separator, so that no word is cut."""
    cuts, at = [0], 0
    while len(raw) - at > limit:
        separators = np.flatnonzero(_IS_SPACE[raw[at + limit : at + 2 * limit]])
        if len(separators) == 0:
            later = np.flatnonzero(_IS_SPACE[raw[at + limit :]])
            if len(later) == 0:
                break
            separators = later
        at = at + limit + int(separators[0])
        cuts.append(at)
    return [*cuts, len(raw)]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the number of words of each row.

    Long texts are taken in pieces, so temporary arrays stay small whatever a
    text's length.
    """
    raw, offsets = string_buffers(column)
    if len(raw) <= 2 * PIECE_BYTES:
        hashes, starts = _hash_words(raw, offsets[:-1])
        edges = np.searchsorted(starts, offsets)
        return hashes, np.diff(edges)
    parts, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for row in range(len(counts)):
        text = raw[offsets[row] : offsets[row + 1]]
        cuts = _split(text, PIECE_BYTES)
        for a, b in zip(cuts, cuts[1:]):
            hashes, _ = _hash_words(text[a:b], np.zeros(1, dtype=np.int64))
            parts.append(hashes)
            counts[row] += len(hashes)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted within the row, and their number.

    A row with fewer words than ``size`` has its whole sequence as one shingle;
    a row without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    total = len(words)
    long = counts >= size
    windows = np.zeros(total, dtype=np.uint64)
    if total >= size:
        span = total - size + 1
        for place in range(size):
            windows[:span] += mixed(words[place : place + span] + _PLACE_VALUE[place])
    kept = np.ones(total, dtype=bool)
    for row_end in (ends[long][:, None] - np.arange(1, size)[None, :]).T:
        kept[row_end] = False
    for row in np.flatnonzero(~long & (counts > 0)):
        a, b = begins[row], ends[row]
        kept[a + 1 : b] = False
        places = np.arange(b - a)
        windows[a] = np.sum(mixed(words[a:b] + _PLACE_VALUE[places])) + np.uint64(b - a)
    rows = np.repeat(np.arange(len(counts)), counts)[kept]
    values = mixed(windows[kept])
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    edges = np.searchsorted(rows, np.arange(len(counts) + 1))
    for row in range(len(counts)):
        distinct = np.unique(values[edges[row] : edges[row + 1]])
        out.append(distinct)
        sizes[row] = len(distinct)
    return np.concatenate(out) if out else np.empty(0, np.uint64), sizes
