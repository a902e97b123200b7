"""Licence scans: Aho-Corasick over the words of whole texts, plus licence expressions.

A text's words (A-Z lowered; runs of letters, digits and non-ASCII bytes) are joined by
single spaces and searched once for all phrases. Where an identifier tag stands, its
expression is read from the original text to the end of the line, parsed by a
shunting-yard parser (``with`` over ``and`` over ``or``, brackets) and evaluated: the
labels it names and the obligation of the cheapest choice (``or`` takes the lesser,
``and`` the greater side; an exception lowers a copyleft by one).

Defined cases: null and empty texts have no words, no labels and score 0; malformed
expressions are read up to the fault; an empty table gives no rows; repeated rows and
null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._store import table
from casewright.llm._words import texts_of

#: Phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases (as words) and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "released into the public domain": "public-domain",
}
#: Phrases that announce a licence expression.
TAGS = ("spdx license identifier", "license expression")
#: Identifiers by their first part, with their label and obligation: 0 none, 1 notice, 2 weak, 3 strong copyleft, 4 closed.
FAMILIES = {
    "mit": ("mit", 1), "apache": ("apache-2", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "cc0": ("public-domain", 0), "unlicense": ("public-domain", 0),
    "mpl": ("mpl", 2), "epl": ("epl", 2), "lgpl": ("lgpl", 2), "gpl": ("gpl", 3), "agpl": ("agpl", 3),
    "cc-by-nc": ("cc-by-nc", 4), "cc-by-sa": ("cc-by-sa", 3), "cc-by": ("cc-by", 1), "proprietary": ("all-rights-reserved", 4),
}
#: Each kind of evidence leaves this share of the doubt.
DOUBT = {"tag": 0.02, "base": 0.1, "notice": 0.2}

_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TAG_LINE = re.compile(r"(?:spdx-license-identifier|license[- ]expression)\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def identify(identifier: str) -> tuple[frozenset, int] | None:
    """Label and obligation of an identifier, by its longest known beginning."""
    parts = identifier.lower().rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        if (found := FAMILIES.get("-".join(parts[:n]))) is not None:
            return frozenset([found[0]]), found[1]
    return None


def evaluate(expression: str) -> tuple[frozenset, int] | None:
    """(labels, obligation) of a licence expression, None if it names nothing known.

    Two operands without an operator end the expression, as does an unmatched bracket.
    """
    values: list = []
    pending: list[str] = []

    def apply():
        op = pending.pop()
        right, left = values.pop(), values.pop()
        if op == "with":
            values.append((left[0], left[1] - 1 if left[1] in (2, 3) else left[1]) if left else None)
        elif left is None or right is None:
            values.append(left or right)
        else:
            values.append((left[0] | right[0], (min if op == "or" else max)(left[1], right[1])))

    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low == "(" and operand_next:
            pending.append(low)
        elif low == ")" and not operand_next and "(" in pending:
            while pending[-1] != "(":
                apply()
            pending.pop()
        elif low in _STRENGTH and not operand_next:
            while pending and pending[-1] != "(" and _STRENGTH[pending[-1]] >= _STRENGTH[low]:
                apply()
            pending.append(low)
            operand_next = True
        elif low not in _STRENGTH and low not in "()" and operand_next:
            values.append(identify(low))
            operand_next = False
        else:
            break
    while pending and len(values) < 1 + sum(op != "(" for op in pending):
        pending.pop()  # an operator without its right side
    while pending:
        if pending[-1] == "(":
            pending.pop()
        else:
            apply()
    return values[0] if values else None


@functools.lru_cache(maxsize=1)
def _automaton():
    a = ahocorasick.Automaton()
    for phrase, what in [*((p, ("base", label)) for p, label in BASE.items()), *((p, ("notice", label)) for p, label in NOTICES.items()), *((p, ("tag", "")) for p in TAGS)]:
        a.add_word(phrase, (len(phrase), what))
    a.make_automaton()
    return a


def scan(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, obligation of one text."""
    words = (text or b"").translate(_TO_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, None
    line = b" ".join(words).decode("latin-1")  # one character per byte: positions stay cheap and phrases are ASCII
    starts, base, labels, kinds, obligation = [], set(), set(), set(), None
    for end, (length, (kind, label)) in _automaton().iter(line):
        at = end - length + 1
        if (at and line[at - 1] != " ") or (end + 1 < len(line) and line[end + 1] != " "):
            continue
        if kind == "base":
            starts.append(line.count(" ", 0, at))
            base.add(label)
        if kind != "tag":
            labels.add(label)
            kinds.add(kind)
        elif "tag" not in kinds:
            for found in _TAG_LINE.findall(text.decode("utf-8", "replace")):
                if got := evaluate(found):
                    kinds.add("tag")
                    labels |= got[0]
                    obligation = got[1] if obligation is None else max(obligation, got[1])
    doubt = 1.0
    for kind in sorted(kinds):
        doubt *= DOUBT[kind]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt, obligation


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, obligation int"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32())
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; ``obligation`` is 0 (none) to 4 (closed) where an expression was read, else null."""

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in texts_of(batch.column(1))]
            cols = [batch.column(0), *(list(zip(*found)) or [[]] * 8)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
