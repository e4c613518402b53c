"""Words of a batch of texts as 64-bit hashes, for operators that run numpy in their tasks.

A word is a maximal run of bytes other than ASCII white space, which UTF-8 never splits. A
batch is cut into pieces of whole texts small enough for the CPU's cache; in each piece words
are hashed eight bytes at a time, all words at once, each step by a bijection of what was
hashed so far and the bytes that follow. Words of one length up to eight bytes never share a
hash; others do by chance alone, once in 2 ** 64 pairs. The few words over ``LONG`` bytes are
hashed by BLAKE2b. The hash depends on the word's bytes alone, so it agrees among tasks and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: Bytes of the longest string that is hashed side by side with others, and spare bytes after the last.
LONG, SPARE = 64, 8
_SEED = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = _SPACE.copy()
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_EMPTY = mix(np.arange(LONG + 1, dtype=np.uint64) * np.uint64(_SEED) + np.uint64(1))


def eights(buf: np.ndarray) -> np.ndarray:
    """At each place of ``buf`` but the last seven, the number that the next eight bytes make."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))


def hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the strings that lie at ``starts`` in ``buf``, which ends in SPARE spare bytes."""
    read = eights(buf)
    out = _EMPTY[np.minimum(sizes, LONG)]
    active, at, left = slice(None), starts, sizes
    while len(at):
        out[active] = mix(out[active] ^ (read[at] & _MASK[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG))
        active = more if isinstance(active, slice) else active[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > LONG):
        digest = hashlib.blake2b(buf[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


def _hash(raw: np.ndarray, first: np.ndarray, lower: bool, apart: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``raw``; texts begin at ``first``.

    With ``heads``, the hashes have a column for each length (8 at most): of the first bytes of
    words that are longer, 0 for others.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, np.zeros((0, 1 + len(heads)) if heads else 0, np.uint64)
    buf = np.zeros(len(raw) + SPARE, np.uint8)
    buf[: len(raw)] = _LOWER[raw] if lower else raw
    solid = ~apart[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = first[first < len(raw)]
    begins[at] = solid[at]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = at[at > 0] - 1
    stops[last] = solid[last]
    starts = np.flatnonzero(begins)
    size = np.flatnonzero(stops) - starts + 1
    h = hashes(buf, starts, size)
    if heads:
        begin = eights(buf)[starts]
        cut = [np.where(size > k, mix((begin & _MASK[k]) ^ mix(np.array([(k << 32) + 1], np.uint64))), np.uint64(0)) for k in heads]
        h = np.stack([h, *cut], axis=1)
    return starts, h


def pieces(texts: pa.Array, lower: bool = False, punctuation: bool = False, heads: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive texts i..j: (i, j, hashes of all their words, first word of each text and the end).

    With ``punctuation``, ASCII punctuation parts words as space does. Null texts have no
    words. A text longer than a piece is a piece of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        first = off[i : j + 1] - off[i]
        starts, h = _hash(raw[off[i] : off[j]], first[:-1], lower, _MARKS if punctuation else _SPACE, heads)
        yield i, j, h, np.searchsorted(starts, first)
        i = j


def shingles(h: np.ndarray, first: np.ndarray, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the first run of each text and the end.

    With ``whole``, a text of 1 to width - 1 words counts as one run.
    """
    n = np.diff(first)
    runs = np.maximum(n - width + 1, 0)
    with np.errstate(over="ignore"):
        m = max(len(h) - width + 1, 0)
        g = np.zeros(m, np.uint64)
        for k in range(width):
            g = mix(g + h[k : k + m] + np.uint64(k + 1))
    text = np.repeat(np.arange(len(n)), n)[:m]
    end = np.repeat(first[1:], n)[:m]
    inside = np.arange(m) + width <= end
    g, text = g[inside], text[inside]
    if whole and (short := np.flatnonzero((n > 0) & (n < width))).size:
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.zeros(1, np.uint64)
            for k in range(first[d], first[d + 1]):
                with np.errstate(over="ignore"):
                    x = mix(x + h[k] + np.uint64(k - first[d] + 1))
            extra[i] = x[0]
        runs[short] = 1
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        g = np.concatenate([g, extra])[order]
    return g, np.concatenate([[0], np.cumsum(runs)])
