"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates what the tags say.

A-Z is lowered and words are maximal runs of letters, digits and characters beyond ASCII. One automaton
passes over the words of a text, joined by single spaces, and finds all notices at once,
so case, punctuation and line breaks don't count; places are counted in words from 0. A second one passes over the lowered
text itself for identifier tags, whose expressions need their punctuation.

An expression is the longest run of tokens after a tag, on its line, in which operands and
operators take turns. ``with`` binds before ``and``, ``and`` before ``or``. Operators and operands are put in
postfix order by the two stacks of the shunting yard and evaluated to the labels that must be
met and how much they restrict (0 to 1): ``and`` unites labels and takes the larger restriction, ``or`` takes
the side that restricts less (the left of two equal ones), ``with`` takes a known exception's share off. An unknown
identifier is labelled ``unknown`` and restricts fully. An expression that ends after an operator, or with open
parentheses, is malformed: it is counted, and its labels are ``unknown``.

``labels`` are those of all notices, and those that any well-formed expression must meet; ``score`` is the
largest restriction of all of them, 0 for a text without any. Null texts are empty. Rows are judged by
themselves: repeated rows give repeated results, and an empty table none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels as given; all their places are counted.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices beyond the base: words -> label.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "public-domain",
    "all rights reserved": "reserved",
    "proprietary and confidential": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Beginnings of identifiers, the longest that fits counts -> label.
IDENTIFIERS = {
    "0bsd": "public-domain", "agpl-": "agpl", "apache-": "apache", "artistic-": "artistic", "bsd-": "bsd", "bsl-": "bsl", "cc-by-": "cc-by", "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa", "cc0-": "cc0", "cddl-": "cddl", "epl-": "epl", "gpl-": "gpl", "isc": "isc", "lgpl-": "lgpl", "mit": "mit", "mpl-": "mpl", "unlicense": "public-domain", "zlib": "zlib",
}
#: How much a label restricts reuse.
RESTRICTS = {
    "public-domain": 0.0, "cc0": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "zlib": 0.1, "apache": 0.2, "artistic": 0.3, "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "cddl": 0.5,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.8, "cc-by-nc": 0.9, "agpl": 0.9, "reserved": 1.0, "unknown": 1.0,
}
#: Beginnings of exceptions -> the factor that is left of a restriction.
EXCEPTIONS = {"classpath-exception": 0.5, "gcc-exception": 0.5, "linux-syscall-note": 0.5, "llvm-exception": 0.5, "autoconf-exception": 0.5, "bison-exception": 0.5, "font-exception": 0.5}
BINDS = {"or": 1, "and": 2, "with": 3}

_TABLE = bytes(32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+\-]*)")
_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, n_tags long, n_malformed long"

Value = tuple[frozenset[str], float]


def _begins(table: dict[str, object], name: str) -> object | None:
    fits = [k for k in table if name == k or name.startswith(k if k.endswith("-") or "-" in k else k + "-")]
    return table[max(fits, key=len)] if fits else None


@cache
def operand(name: str) -> Value:
    """What an identifier stands for."""
    label = _begins(IDENTIFIERS, name.rstrip("+")) or "unknown"
    return frozenset([label]), RESTRICTS[label]


def postfix(text: str, at: int = 0, stop: int | None = None) -> list[str] | None:
    """The tokens in postfix order of the expression that begins ``at`` a place of ``text`` and ends before ``stop``; None if it is malformed or there is none."""
    out: list[str] = []
    stack: list[str] = []
    wants, stop = True, len(text) if stop is None else stop  # an operand (or an opening parenthesis) is due
    while (m := _TOKEN.match(text, at, stop)) is not None:
        token = m[1]
        if token == "(":
            if not wants:
                break
            stack.append(token)
        elif token == ")":
            if wants or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif token in BINDS:
            if wants:
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            wants = True
        else:
            if not wants:
                break
            out.append(token)
            wants = False
        at = m.end()
    if wants or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(tokens: list[str]) -> Value:
    """What must be met, and how much that restricts. An exception takes its share off the restriction of what it is added to."""
    values: list[tuple[frozenset[str], float, str]] = []
    for token in tokens:
        if token not in BINDS:
            values.append((*operand(token), token))
            continue
        (b, rb, name), (a, ra, _) = values.pop(), values.pop()
        if token == "and":
            values.append((a | b, max(ra, rb), ""))
        elif token == "or":
            values.append((a, ra, "") if ra <= rb else (b, rb, ""))
        else:
            values.append((a, ra * (_begins(EXCEPTIONS, name) or 1.0), ""))
    return values[0][:2]


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        notices.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan(text: str) -> tuple:
    """The result columns of one text."""
    notices, tags = _automata()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_notices, base, labels, score = 0, [], set(), 0.0
    place, seen = 0, 0
    found = sorted((end - size, label, own) for end, (size, label, own) in notices.iter(line))
    for start, label, own in found:
        place += line.count(" ", seen, start)
        seen = start
        n_notices += 1
        labels.add(label)
        score = max(score, RESTRICTS[label])
        if own:
            base.append((place, label))
    n_tags = malformed = 0
    low = raw.translate(_LOWER).decode("utf-8", "surrogatepass")
    stop = 0  # the end of the line that the tag is on, sought once for all tags of a line
    for end, _ in tags.iter(low):
        n_tags += 1
        if stop <= end:
            stop = low.find("\n", end)
            stop = len(low) if stop < 0 else stop
        tokens = postfix(low, end + 1, stop)
        got, restricts = evaluate(tokens) if tokens else (frozenset(["unknown"]), RESTRICTS["unknown"])
        malformed += not tokens
        labels |= got
        score = max(score, restricts)
    at = [p for p, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, n_notices, n_tags, malformed


def scans(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` of every row of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and counts of notices and tags."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _RESULT.split(", ")]
    packed = docs.select(F.struct(*carry).alias("_own"), F.col("text").alias("_text"))
    schema = packed.schema["_own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column("_text")]
            cells = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("_own"), *cells], names=["_own", *names])

    return packed.mapInArrow(run, f"_own {schema}, {_RESULT}").select("_own.*", *[c for c in names if c not in carry])
