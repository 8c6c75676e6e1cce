"""License scans: Aho-Corasick for tags and notice phrases, a shunting-yard parser for expressions.

A text becomes its lower-cased words, joined by single blanks; one automaton
finds every phrase that stands there as whole words. Base phrases count, first
and last give places; further phrases add labels of their own. Where the words
of an SPDX tag are found, the expression after each tag in the raw text is
parsed by the shunting-yard algorithm (WITH binds tighter than AND, AND than OR)
and evaluated: its licences become labels, and it is met if a choice of
licences exists in which all are permissive.

``score`` is the confidence that the text states a licence: 1 minus the product
of the doubts of its distinct labels (0 without labels).

Edge cases: a null or wordless text has no words, places or labels and score 0;
malformed expressions give the licences read before the fault; repeated rows
stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import lean

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrase to (label, doubt that the label is right).
NOTICES = {
    "cc by nc": ("cc-by-nc", 0.1), "cc by sa": ("cc-by-sa", 0.1), "cc by nd": ("cc-by-nd", 0.1), "cc by nc sa": ("cc-by-nc-sa", 0.1), "cc by nc nd": ("cc-by-nc-nd", 0.1),
    "cc0 1 0": ("cc0", 0.1), "cc by 4 0": ("cc-by-4.0", 0.05), "cc by nc 4 0": ("cc-by-nc-4.0", 0.05), "cc by sa 4 0": ("cc-by-sa-4.0", 0.05), "creative commons": ("cc", 0.3),
    "gnu general public license": ("gnu-gpl", 0.1), "general public license version 2": ("gpl-2.0", 0.05), "general public license version 3": ("gpl-3.0", 0.05),
    "lesser general public license": ("lgpl", 0.1), "affero general public license": ("agpl", 0.1), "mit license": ("mit", 0.1),
    "permission is hereby granted free of charge": ("mit", 0.1), "apache license": ("apache", 0.2), "apache license version 2 0": ("apache-2.0", 0.05),
    "redistribution and use in source and binary forms": ("bsd", 0.1), "bsd license": ("bsd", 0.2), "mozilla public license": ("mpl", 0.1), "isc license": ("isc", 0.2),
    "public domain": ("public-domain", 0.5), "spdx license identifier": ("spdx", 0.1), "licensed under": ("licensed", 0.7), "all rights reserved": ("reserved", 0.3),
}
BASE_DOUBT = 0.2
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "zlib", "unlicense", "0bsd", "public-domain")

_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_TAG = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def shunting_yard(text: str) -> tuple[list[str], bool]:
    """The expression in postfix order, up to its first fault, and whether it was sound."""
    out, stack, operand, depth = [], [], False, 0
    for m in _TOKEN.finditer(text):
        t, low = m.group(), m.group().lower()
        if low in _BINDS:
            if not operand:
                return out, False
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif t == "(":
            if operand:
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if not depth or not operand:
                return out, False
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if operand:  # a comment or the like follows the expression
                break
            out.append(t)
            operand = True
    if depth or not operand:
        return [t for t in out if t not in _BINDS], False
    return out + stack[::-1], True


def evaluate(postfix: list[str], permissive: tuple[str, ...] = PERMISSIVE) -> tuple[list[str], bool]:
    """The licences named, and whether some choice among them is all permissive."""
    stack: list[tuple[str | None, bool]] = []
    names = []
    for t in postfix:
        if t in _BINDS:
            (_, b), (name, a) = (stack.pop(), stack.pop()) if len(stack) > 1 else ((None, False), (None, False))
            if t == "with":  # an exception is no licence of its own
                exception = names.pop() if names else None
                if name is not None and names and exception is not None:
                    names[-1] = f"{names[-1]}-with-{exception}"
                stack.append((name, a))
            else:
                stack.append((None, a or b if t == "or" else a and b))
        else:
            names.append(t.lower().rstrip("+"))
            stack.append((t.lower(), t.lower().startswith(permissive)))
    return sorted(set(names)), bool(stack) and stack[-1][1]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in BASE.keys() | NOTICES.keys():
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, machine) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    # latin-1 keeps one character for each byte
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found, starts, doubts = set(), [], {}
    at = blanks = 0
    for end, phrase in machine.iter(line):
        start = end - len(phrase) - 1
        label, doubt = NOTICES.get(phrase, (None, 1.0))
        if phrase in BASE:
            if start >= at:
                blanks += line.count(" ", at, start)
                at = start
                place = blanks
            else:
                place = line.count(" ", 0, start)
            starts.append(place)
            found.add(BASE[phrase])
            doubts[BASE[phrase]] = min(doubts.get(BASE[phrase], 1.0), BASE_DOUBT)
        if label is not None:
            doubts[label] = min(doubts.get(label, 1.0), doubt)
    if "spdx" in doubts:
        for m in _TAG.finditer(text or ""):
            names, met = evaluate(shunting_yard(m.group(1))[0])
            doubts |= {n: 0.02 for n in names}
            if names:
                doubts["spdx-permissive" if met else "spdx-restricted"] = 0.1
    score = 1.0
    for label in sorted(doubts):
        score *= doubts[label]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(doubts)), 1.0 - score if doubts else 0.0


_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for b in batches:
        rows = [scan(t, machine) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], ["doc_id", *_NAMES])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, places and labels for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_scan), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
