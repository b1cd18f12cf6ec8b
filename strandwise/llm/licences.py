"""License scan: Aho-Corasick over words, licence expressions by shunting-yard.

One automaton finds notice phrases as consecutive words; a second finds
identifier tags in the raw text. What follows a tag is read as a licence
expression: identifiers joined by ``and``, ``or``, ``with`` and parentheses.
A shunting-yard parser turns it into postfix order, over which one pass tells
whether some open choice of licences satisfies it; expressions may be of any
length.

Null and empty texts have no words and no labels. A malformed expression gives
the identifiers that it names and is not open. Repeated rows are scanned alike;
empty tables give no rows; other columns are ignored. Whole texts are scanned,
and places are counted without a bound. The score is e / (1 + e) of the
evidence e: one for each place of a phrase and each expression that names a
known licence, a quarter for an expression that names none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, spread, table, texts

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases; ``none`` of them is a base phrase.
PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "no part of this": "reserved",
    "without written permission": "reserved",
    "isc license": "isc",
    "the unlicense": "unlicense",
}
TAGS = ("spdx-license-identifier:", "spdx-license-identifier=", "license-expression:", "license:", "licence:")
#: Identifier prefixes and the label they give.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mit", "mit"), ("apache", "apache"), ("bsd", "bsd"), ("mpl", "mpl"), ("isc", "isc"), ("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("unlicense", "unlicense"), ("epl", "epl"), ("proprietary", "reserved"))
#: Free to train on without more conditions than attribution.
OPEN = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "public-domain"})
#: Words are ASCII letters and digits and all other characters; everything else parts them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: ``with`` binds tightest, then ``and``, then ``or``; all to the left.

    Raises ValueError where the expression is malformed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                raise ValueError("an operator is missing")
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("an identifier is missing")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced")
            stack.pop()
        elif token in _RANK:
            if operand:
                raise ValueError("an identifier is missing")
            while stack and _RANK.get(stack[-1], 0) >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                raise ValueError("an operator is missing")
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("unfinished")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[bool, list[str]]:
    """(whether an open choice satisfies the expression, its licences in order).

    ``x with y`` is as open as x, and y is an exception and no licence. Linear in
    the expression's length. Raises ValueError where it is malformed.
    """
    stack: list[tuple[bool, int]] = []  # open, number of the first identifier
    names: list[str] = []
    exception: list[bool] = []
    for token in postfix(expression):
        if token not in _RANK:
            stack.append((label(token) in OPEN, len(names)))
            names.append(token)
            exception.append(False)
            continue
        (b, at), (a, first) = stack.pop(), stack.pop()
        if token == "with":
            exception[at:] = [True] * (len(names) - at)
            stack.append((a, first))
        else:
            stack.append((a or b if token == "or" else a and b, first))
    return stack[0][0], [n for n, gone in zip(names, exception, strict=True) if not gone]


def label(identifier: str) -> str | None:
    return next((name for prefix, name in FAMILIES if identifier.startswith(prefix)), None)


@lru_cache(maxsize=1)
def automata():
    import ahocorasick

    words = ahocorasick.Automaton()
    for phrase, name in [*PHRASES.items(), *BASE.items()]:
        words.add_word(f" {phrase} ", (len(phrase) + 2, name, phrase in BASE))
    words.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return words, tags


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EXPRESSION = re.compile(r"[ \t]*([a-z0-9(][a-z0-9.+:() \t-]*)")


def expressions(text: bytes) -> list[str]:
    """What follows identifier tags, up to the end of the expression's signs."""
    lower = text.translate(_LOWER)
    if b"licen" not in lower:
        return []
    # one character for each byte keeps offsets; tags and expressions are ASCII
    line = lower.decode("latin-1")
    out = []
    for end, _ in automata()[1].iter(line):
        if got := _EXPRESSION.match(line, end + 1):
            out.append(_cut(got[1]))
    return [x for x in out if x]


def _cut(raw: str) -> str:
    """Tokens while they can belong to one expression: operands and operators by turns."""
    out, operand, depth = [], True, 0
    for token in _TOKEN.findall(raw):
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif token in _RANK and not operand:
            operand = True
        elif token not in ("(", ")") and token not in _RANK and operand:
            operand = False
            token = token.rstrip(".:-")
        else:
            break
        out.append(token)
    while out and (out[-1] in _RANK or out[-1] == "("):
        depth -= out.pop() == "("
    return " ".join(out)


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    words = text.translate(_FOLD).split()
    base: set[str] = set()
    found: set[str] = set()
    starts: list[int] = []
    places: set[int] = set()
    if words:
        line = b" ".join([b"", *words, b""]).decode()
        for end, (size, name, is_base) in automata()[0].iter(line):
            found.add(name)
            places.add(end + 1 - size)
            if is_base:
                base.add(name)
                starts.append(end + 1 - size)
    at: list[int] = []
    if starts:  # the word number is the number of spaces before
        done = count = 0
        for s in sorted(starts):
            count += line.count(" ", done, s)
            done = s
            at.append(count)
    said = expressions(text)
    free, evidence = False, float(len(places))
    for x in said:
        try:
            own, names = evaluate(x)
            free |= own
        except ValueError:
            names = [t for t in _TOKEN.findall(x) if t not in _RANK and t not in "()"]
        known = {n for n in map(label, names) if n}
        found |= known
        evidence += 1.0 if known else 0.25
    score = evidence / (1 + evidence)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(found)), score, free, said


def scans(docs: DataFrame) -> DataFrame:
    """One row for each row: counts, labels, score, and the expressions with whether one of them is open."""

    def work(batch):
        rows = list(zip(*map(scan, texts(batch)), strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_(), pa.list_(pa.string())]
        return batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, open boolean, expressions array<string>"
    return map_texts(spread(docs.select("doc_id", "text")), "text", schema, work)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(table(spark, sf_dir, "documents"))
