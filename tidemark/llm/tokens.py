"""Token counts of a byte-level BPE with the whole-token shortcut.

The pre-tokenizer cuts a text into pieces that are merged one by one, so a text's count is the
sum over its pieces. Offline, each string of the vocabulary is encoded by the library; those
that come out as one token count as 1 by a lookup. Only other pieces are merged, by the
library, once per worker for each different piece while they fit the cache.

Pieces are found with numpy on whole batches: offline, the library sorts every assigned code
point into letter, number, space and other, and a piece is a run of one class with the rules
for spaces and contractions below. A text with any code point that is not sorted so is encoded
whole by the library. Pieces are looked up by 64-bit hashes of their UTF-8 bytes, and what is
found counts only if its bytes are those of the piece. Special strings in a text count as one
token, the library's default. Null texts are empty: 0 tokens.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import LONG, SPARE, eights, hashes

#: Different pieces that a worker remembers before it starts anew; code points handled at once.
CACHE = 2_000_000
AT_ONCE = 1 << 19
#: Code points that are tried at once.
TRIED = 128
OTHER, LETTER, NUMBER, SPACE, EDGE, UNKNOWN = 0, 1, 2, 3, 4, 5
#: What follows an apostrophe in the pieces that the pre-tokenizer cuts first. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.lru_cache(2)
def load(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(2)
def proofs(path: str) -> tuple[tuple[str, ...], np.ndarray, tuple[str, ...]]:
    """Strings that encode alone as one token, the class of every code point, special strings."""
    t = load(path)
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())
    cut = t.pre_tokenizer.pre_tokenize_str
    texts = [s for s in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())) if s and "�" not in s and s not in special]
    single = tuple(s for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1 and len(cut(s)) == 1)
    return single, classes(cut), special


def classes(cut: Callable[[str], list]) -> np.ndarray:
    """The class of every assigned code point, by how the pre-tokenizer ``cut`` parts it from its like.

    Code points of one Unicode category are tried together behind a character of a known class;
    where they don't come out as one piece, each is tried alone.
    """
    kinds, alike = np.full(0x110000, UNKNOWN, np.uint8), {}
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (kind := unicodedata.category(chr(i))) not in ("Cn", "Co"):
            alike.setdefault(kind[0], []).append(i)
    for kind, points in alike.items():
        first = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
        for k in range(0, len(points), TRIED):
            some = points[k : k + TRIED]
            if len(cut("!a1"[first] + "".join(map(chr, some)))) == 1:
                kinds[some] = first
                continue
            for i in some:
                one = [len(cut(f"{x}{chr(i)}")) == 1 for x in "!a1"]
                if sum(one) == 1:
                    kinds[i] = one.index(True)
                elif not any(one) and len(cut(chr(i) * 2)) == 1:
                    kinds[i] = SPACE
    return kinds


def piece_starts(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point, for texts that begin at ``first``."""
    n = len(cp)
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[np.append(first[1:], n) - 1] = EDGE, EDGE
    blank = np.zeros(n, bool)
    blank[1:] = cp[:-1] == 32
    blank &= before == SPACE
    space = kind == SPACE
    start = ~space & (kind != before) & ~blank
    # a run of spaces is a piece but for its last one if text follows: that one, if a blank, joins the text
    start |= space & ((before != SPACE) | ((after != SPACE) & (after != EDGE)))
    at = np.flatnonzero(start & (cp == 39) & (after == LETTER))
    end = np.append(first[1:], n)[np.searchsorted(first, at, "right") - 1]
    for tail in CONTRACTIONS:
        k = len(tail)
        ok = at + k < end
        for j, c in enumerate(tail):
            ok &= cp[np.minimum(at + 1 + j, n - 1)] == ord(c)
        hit, stop = at[ok], at[ok] + k + 1
        start[hit + 1] = False
        stop = stop[stop < end[ok]]
        start[stop[kind[stop] == LETTER]] = True
    return start


class Counter:
    """Counts tokens of lists of texts; keeps what it merged, sorted by hash, with the bytes of each piece."""

    def __init__(self, path: str, single: tuple[str, ...], kinds: np.ndarray, special: tuple[str, ...]) -> None:
        self.lib, self.kinds = load(path), kinds
        self.marks = re.compile("|".join(map(re.escape, special))) if special else None
        self.single = [x for s in single if len(x := s.encode()) <= LONG]
        self.forget()

    def forget(self) -> None:
        self.keys, self.n, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = np.zeros(SPARE, np.uint8)
        buf = np.frombuffer(b"".join(self.single) + bytes(SPARE), np.uint8)
        size = np.array([len(x) for x in self.single], np.int64)
        self.learn(buf, np.cumsum(size) - size, size, np.ones(len(size), np.int64))

    def learn(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> None:
        """Remember the counts ``n`` of pieces whose hashes are new, one of each hash."""
        h, which = np.unique(hashes(buf, starts, sizes), return_index=True)
        starts, sizes, n = starts[which], sizes[which], n[which]
        place, used = np.searchsorted(self.keys, h), len(self.bytes) - SPARE
        within = np.cumsum(sizes) - sizes
        flat = np.repeat(starts - within, sizes) + np.arange(sizes.sum())
        self.bytes = np.concatenate([self.bytes[:used], buf[flat], np.zeros(SPARE, np.uint8)])
        self.keys, self.n = np.insert(self.keys, place, h), np.insert(self.n, place, n)
        self.at, self.size = np.insert(self.at, place, used + within), np.insert(self.size, place, sizes)

    def find(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece of at most LONG bytes is remembered, and whether it is: hash, size and bytes agree."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = (self.keys[at] == h) & (self.size[at] == sizes)
        ours, theirs = eights(self.bytes), eights(buf)
        look = np.flatnonzero(same)
        for k in range(0, LONG, 8):
            unused = np.maximum(64 - 8 * (sizes[look] - k), 0).astype(np.uint64)
            differ = ((ours[self.at[at[look]] + k] ^ theirs[starts[look] + k]) << unused) != 0
            same[look[differ]] = False
            look = look[~differ & (sizes[look] > k + 8)]
            if not len(look):
                break
        return at, same

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner, size = [], [], 0
        for i, text in enumerate(texts):
            cut = [text]
            if self.marks and self.marks.search(text):
                cut = self.marks.split(text)
                out[i] += len(cut) - 1
            for part in filter(None, cut):
                if size + len(part) > AT_ONCE and parts:
                    self.add(parts, owner, out)
                    parts, owner, size = [], [], 0
                parts.append(part)
                owner.append(i)
                size += len(part)
        if parts:
            self.add(parts, owner, out)
        return out

    def add(self, parts: list[str], owner: list[int], out: np.ndarray) -> None:
        joined = "".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *map(len, parts[:-1])])
        kind = self.kinds[cp]
        if (odd := np.flatnonzero(kind == UNKNOWN)).size:
            bad = set((np.searchsorted(first, odd, "right") - 1).tolist())
            for k in bad:
                out[owner[k]] += len(self.lib.encode(parts[k], add_special_tokens=False).ids)
            if rest := [k for k in range(len(parts)) if k not in bad]:
                self.add([parts[k] for k in rest], [owner[k] for k in rest], out)
            return
        starts = np.flatnonzero(piece_starts(cp, kind, first))
        text = joined.encode("utf-8", "surrogatepass")
        buf = np.frombuffer(text + bytes(SPARE), np.uint8)
        bounds = np.append(starts, len(cp))
        if len(text) > len(cp):
            wide = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
            bounds = np.append(0, np.cumsum(wide))[bounds]
        begin, size = bounds[:-1], np.diff(bounds)
        n = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= LONG)
        h = hashes(buf, begin[short], size[short])
        at, known = self.find(buf, begin[short], size[short], h)
        if not known.all():
            new = np.flatnonzero(~known & (self.keys[at] != h if len(self.keys) else True))
            fresh = short[new[np.unique(h[new], return_index=True)[1]]]
            if len(self.keys) + len(fresh) > CACHE + len(self.single):
                self.forget()
            self.learn(buf, begin[fresh], size[fresh], self.merged(text, begin[fresh], size[fresh]))
            at, known = self.find(buf, begin[short], size[short], h)
        n[short[known]] = self.n[at[known]]
        # long pieces, and those whose hash stands for another piece
        rest = np.append(short[~known], np.flatnonzero(size > LONG))
        n[rest] = self.merged(text, begin[rest], size[rest])
        np.add.at(out, owner, np.add.reduceat(n, np.searchsorted(starts, first)))
        return None

    def merged(self, text: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The library's counts of pieces of ``text``; each different one is merged once."""
        pieces = [text[a : a + k] for a, k in zip(begin.tolist(), size.tolist(), strict=True)]
        each = dict.fromkeys(pieces)
        for piece, e in zip(each, self.lib.encode_batch([p.decode() for p in each], add_special_tokens=False), strict=True):
            each[piece] = len(e)
        return np.array([each[p] for p in pieces], np.int64)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, by the tokenizer file at ``path``.

    ``path`` must exist on every executor. An empty table gives an empty result.
    """
    facts = docs.sparkSession.sparkContext.broadcast(proofs(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path, *facts.value))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counter.count(batch["text"].tolist())})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
