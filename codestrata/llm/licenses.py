"""Licence scan: Aho-Corasick over notice phrases and identifier tags, shunting-yard over expressions.

A document's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of its text with A-Z lower-cased. One automaton finds
every place where a phrase's words stand consecutively; a second one finds identifier tags in the text, and the licence
expression after a tag (``mit or (apache-2.0 with llvm-exception)``) is turned into postfix by a shunting yard and
evaluated.

Results for odd input: an expression with an unknown exception counts as malformed; a text of any length takes time and
memory linear in it; an empty table gives no rows; a null or empty text has no words, no labels and score 0; a malformed expression gives the label
``spdx-invalid`` and nothing else; rows repeat as they come; a null ``doc_id`` is passed on. The work is one pass
without a shuffle, so no key can become hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, empty_safe, pieces

#: Phrases that the contract fixes, with their labels (fixed values).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases: names of licences, and what their notices and grants say. Apostrophes and hyphens part words.
MORE_PHRASES = {
    # Names.
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "gnu free documentation license": "gfdl",
    "apache license": "apache",
    "apache software license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "business source license": "busl",
    "server side public license": "sspl",
    "creative commons": "creative-commons",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "public-domain",
    # Notices.
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder": "bsd",
    "this is free software you can redistribute it and or modify": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "this library is free software you can redistribute it and or modify": "lgpl",
    "this source code form is subject to the terms": "mpl",
    "released into the public domain": "public-domain",
    "to the extent possible under law": "cc0",
    "licensed under": "licensed",
    "subject to license": "licensed",
    "no part of this publication may be reproduced": "reserved",
    "proprietary and confidential": "reserved",
    "unauthorized copying": "reserved",
}

#: Tags before a licence expression, lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")

#: How freely text under a licence may be used, 0 to 1; the score of an unknown identifier is UNKNOWN. An identifier
#: belongs to the longest family that it begins with, as gpl-3.0-or-later to gpl.
OPENNESS = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "0bsd": 1.0, "mit": 0.9, "bsd": 0.9, "apache": 0.9,
    "isc": 0.9, "zlib": 0.9, "bsl": 0.9, "psf": 0.9, "python": 0.9, "postgresql": 0.9, "ncsa": 0.9, "x11": 0.9, "artistic": 0.8,
    "cc-by": 0.8, "ofl": 0.7, "creative-commons": 0.6, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cc-by-sa": 0.5, "lgpl": 0.5,
    "eupl": 0.5, "gfdl": 0.4, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "licensed": 0.3, "cc-by-nc": 0.2, "busl": 0.2,
    "sspl": 0.2, "reserved": 0.1,
}
#: Exceptions that may follow "with"; an expression with another one is malformed.
EXCEPTIONS = frozenset(
    ["classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0", "linux-syscall-note", "llvm-exception", "openssl-exception"]
    + ["openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0", "qt-lgpl-exception-1.1", "swift-exception", "u-boot-exception-2.0", "universal-foss-exception-1.0", "wxwindows-exception-3.1", "ocaml-lgpl-linking-exception", "lgpl-3.0-linking-exception"]
)
UNKNOWN = 0.2
#: What an exception ("with ...") adds to a licence's openness.
EXCEPTION = 0.1

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string())]
)
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"

_WORD_BYTES = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_FAMILIES = sorted(OPENNESS, key=len, reverse=True)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=4)
def _automata(phrases: tuple[str, ...], tags: tuple[str, ...]):
    import ahocorasick

    def automaton(patterns: dict[str, str]):
        out = ahocorasick.Automaton()
        for pattern, name in patterns.items():
            as_bytes = pattern.encode().decode("latin-1")  # a character for each byte
            out.add_word(as_bytes, (len(as_bytes), name))
        out.make_automaton()
        return out

    return automaton({f" {p} ": p for p in phrases}), automaton({t: t for t in tags})


def postfix(expression: str) -> list[str] | None:
    """The tokens of a licence expression in postfix order by a shunting yard; None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if token in _PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                break  # the expression ends where another word follows
            out.append(token)
            operand_next = False
    if operand_next:
        return None
    while stack:
        if (top := stack.pop()) == "(":
            return None
        out.append(top)
    return out


def family(identifier: str) -> str:
    """The family of a licence identifier, as ``gpl`` of ``gpl-3.0-or-later``."""
    for name in _FAMILIES:
        if identifier == name or identifier.startswith(f"{name}-"):
            return name
    return identifier


def known_exceptions(tokens: list[str]) -> bool:
    """Whether each "with" of a postfix expression is preceded by a known exception."""
    return all(tokens[i - 1] in EXCEPTIONS for i, t in enumerate(tokens) if t == "with")


def openness(tokens: list[str]) -> float:
    """The value of a postfix expression: "and" binds to its strictest part, "or" to its freest."""
    stack: list[float] = []
    for token in tokens:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "and" else max(left, right) if token == "or" else min(1.0, left + EXCEPTION))
        else:
            stack.append(OPENNESS.get(family(token), UNKNOWN))
    return stack[-1]


def scan_text(text: bytes, base: dict[str, str], more: dict[str, str]) -> tuple:
    """What one text shows; see ``SCHEMA`` without ``doc_id``."""
    phrases, tags = _automata((*base, *more), TAGS)
    words = text.translate(_WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    labels, base_labels, places, values, expressions = set(), set(), [], [], []
    counted, gaps = 0, 0  # blanks before a place, by a running count: matches come in order of their ends
    for end, (size, phrase) in phrases.iter(joined.decode("latin-1")):
        if phrase in base:
            gaps += joined.count(b" ", counted, end + 1)
            counted = end + 1
            places.append(gaps - phrase.count(" ") - 2)
            base_labels.add(base[phrase])
        labels.add(label := base.get(phrase) or more[phrase])
        values.append(OPENNESS.get(label, UNKNOWN))
    lowered = text.lower()
    tagged = [(end + 1 - size, end + 1) for end, (size, _) in tags.iter(lowered.decode("latin-1"))]
    for (_, begin), (following, _) in zip(tagged, [*tagged[1:], (len(lowered), 0)], strict=False):
        # An expression ends with its line, or where another tag begins.
        stop = lowered.find(b"\n", begin, following)
        line = lowered[begin : stop if stop >= 0 else following].decode("utf-8", "replace")
        tokens = postfix(line)
        if tokens is None or not known_exceptions(tokens):
            labels.add("spdx-invalid")
            continue
        expressions.append(" ".join(tokens))
        labels.update(f"spdx-{family(t)}" for t in tokens if t not in _PRECEDENCE)
        values.append(openness(tokens))
    # What a text asks for most strictly holds for the whole of it.
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), float(min(values, default=0.0)), "; ".join(expressions),
    )


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """A row for each document: its words, the places and labels of licence notices, and a score of openness.

    ``score`` is the openness of the strictest notice or expression found, 0 where there is none.
    """
    base, more = dict(base or BASE_PHRASES), dict(MORE_PHRASES if more is None else more)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            yield batch_of(SCHEMA, [batch.column(0).to_pylist(), *zip(*(scan_text(t, base, more) for t in texts), strict=True)])

    return empty_safe(docs, "doc_id", "text").mapInArrow(scan, DDL)
