"""Words of whole texts as 64-bit hashes, computed over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as
a-z.  White-space bytes never occur inside a multi-byte UTF-8 character, so
the byte view and the code-point view give the same words.  No Python string
is made: a column's buffer is cut into pieces of a few MB and hashed with
numpy, so memory stays bounded whatever the batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_IS_TERM = np.zeros(256, dtype=bool)  # terms: letters and digits only, every non-ASCII byte counts as a letter
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES):
    """Yield (first row, offsets, bytes) of runs of whole texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + piece_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, offsets[row:end + 1] - offsets[row], raw[offsets[row]:offsets[end]]
        row = end


def hash_words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (n + 1 bounds)."""
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = word[firsts]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    place = _places(starts, len(raw))
    longest = int(place[word].max()) + 1
    powers = np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
    values = np.where(word, _BYTE[raw] * powers[np.minimum(place, longest - 1)], np.uint64(0))
    return mix64(np.add.reduceat(values, starts)), bounds


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    lengths = np.diff(np.append(starts, n))
    out = np.zeros(n, dtype=np.int64)
    out[starts[0]:] = np.arange(starts[0], n) - np.repeat(starts, lengths)
    return out


def hash_terms(offsets: np.ndarray, raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all terms and of each longer term's first k characters (0: it has no more than k), and bounds as above.

    Latin-1 capitals count as small letters, too.
    """
    capital = np.zeros(len(raw), dtype=bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    raw = np.where(capital, raw + np.uint8(0x20), raw)
    term = _IS_TERM[raw]
    begins = term.copy()
    begins[1:] &= ~term[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = term[firsts]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + len(prefixes)), bounds
    place = _places(starts, len(raw))
    longest = int(place[term].max()) + 1
    powers = np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
    values = np.where(term, _BYTE[raw] * powers[np.minimum(place, longest - 1)], np.uint64(0))
    out = [mix64(np.add.reduceat(values, starts))]
    seen = np.cumsum((raw & 0xC0) != 0x80)
    nth = seen - np.repeat(seen[starts], np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], seen.dtype), seen[starts[0]:] - np.repeat(seen[starts], np.diff(np.append(starts, len(raw))))])
    size = np.maximum.reduceat(np.where(term, nth, 0), starts) + 1
    for k in prefixes:
        part = mix64(np.add.reduceat(np.where(nth < k, values, np.uint64(0)), starts) + np.uint64(k))
        out.append(np.where(size > k, part, np.uint64(0)))
    return out, bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i:len(words) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1)
        out ^= out >> np.uint64(32)
    return mix64(out)


def word_hash(word: str) -> int:
    """The hash hash_words() gives a single word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hash_words(np.array([0, len(raw)]), raw)[0][0])
