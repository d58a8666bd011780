"""License scans: an Aho-Corasick pass finds notice phrases and identifier tags,
and a shunting-yard parser reads the licence expression behind a tag.

Notices are looked for in the words of the text, so punctuation and line breaks
inside them don't matter; tags are looked for in the text itself, since their
expressions need brackets and plus signs. A tag may follow anything but an ASCII letter
or digit.

Defined cases: a null or empty text has no words, labels or score; a tag whose
expression doesn't parse, or names no known licence, gives nothing; an unknown part
beside a known one has no label, isn't permissive, and stays in the expression's text;
repeated rows are scanned alike; a null doc_id is passed on; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import text_steps

# The base notices.
BASE_NOTICES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notices of this operator.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Tags that a licence expression follows, and identifiers known in one.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:")
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit", "apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3",
    "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl",
    "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl", "mpl-2.0": "mpl",
    "epl-2.0": "epl", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc", "unlicense": "public-domain", "cc0-1.0": "public-domain", "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}
#: Labels that a permissive choice may consist of.
PERMISSIVE = frozenset({"mit", "apache-2", "apache", "bsd", "isc", "public-domain", "cc-by"})
#: How sure one sighting makes: a base notice, another notice, a tag with its expression.
SURE = {"base": 0.8, "notice": 0.6, "tag": 0.9}

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_EXPRESSION_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.\-]*\+?)")


def to_postfix(expression: str, start: int = 0, stop: int | None = None) -> list[str] | None:
    """Dijkstra's shunting-yard over a part of a text; None if that doesn't start with a well-formed expression.

    Reading stops at the first character that can't belong to an expression, or at an
    operand that follows an operand.
    """
    out: list[str] = []
    held: list[str] = []
    at, operand_next, stop = start, True, len(expression) if stop is None else stop
    while m := _EXPRESSION_TOKEN.match(expression, at, stop):
        token = m[1]
        if token == "(":
            if not operand_next:
                break
            held.append(token)
        elif token == ")":
            if operand_next or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        at = m.end()
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


@dataclass(frozen=True)
class Licence:
    """What an expression evaluates to."""

    labels: frozenset[str]
    permissive: bool
    text: str


def evaluate(postfix: list[str]) -> Licence:
    """and: all parts hold; or: one may be chosen; with: an exception to the part before it."""
    stack: list[Licence] = []
    for token in postfix:
        if token in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            text = f"({a.text} {token.upper()} {b.text})"
            if token == "with":
                stack.append(Licence(a.labels, a.permissive, text))
            elif token == "and":
                stack.append(Licence(a.labels | b.labels, a.permissive and b.permissive, text))
            else:
                stack.append(Licence(a.labels | b.labels, a.permissive or b.permissive, text))
        else:
            label = IDENTIFIERS.get(token.rstrip("+"))
            stack.append(Licence(frozenset([label] if label else []), label in PERMISSIVE, token))
    return stack[0]


#: A-Z to a-z, and every byte that can't be in a word to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class LicenceScanner:
    def __init__(self) -> None:
        import ahocorasick

        self.notices = ahocorasick.Automaton()
        for phrase in {**NOTICES, **BASE_NOTICES}:
            self.notices.add_word(f" {phrase} ", (len(phrase) + 2, BASE_NOTICES.get(phrase), NOTICES.get(phrase)))
        self.notices.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, score, expressions, permissive."""
        words = text.translate(_WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        places: list[int] = []
        base, labels, doubt, choices = set(), set(), 1.0, []
        at = counted = 0
        for end, (size, base_label, label) in self.notices.iter(line):
            if base_label:
                start = end + 1 - size
                if start < at:
                    at = counted = 0
                counted += line.count(" ", at, start)
                at = start
                places.append(counted)
                base.add(base_label)
                doubt *= 1 - SURE["base"]
            else:
                labels.add(label)
                doubt *= 1 - SURE["notice"]
        for found in self._expressions(text):
            labels |= found.labels
            choices.append(found)
            doubt *= 1 - SURE["tag"]
        join = lambda x: ",".join(sorted(x))
        permissive = all(x.permissive for x in choices) if choices else None
        return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), 1 - doubt, join({x.text for x in choices}), permissive

    def _expressions(self, text: bytes) -> Iterator[Licence]:
        low = text.lower()
        if b"license" not in low or b":" not in low:  # every tag holds both
            return
        lowered, stop = low.decode("utf-8", "replace"), 0
        for end, tag in self.tags.iter(lowered):
            before = lowered[max(0, end - len(tag)) : end - len(tag) + 1]
            if before.isascii() and before.isalnum():  # the end of a longer word
                continue
            if stop <= end:  # the tags come in order: each line is measured once
                stop = lowered.find("\n", end + 1) % (len(lowered) + 1)
            postfix = to_postfix(lowered, end + 1, stop)
            if postfix and (found := evaluate(postfix)).labels:
                yield found


_SCANNER: list[LicenceScanner] = []
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNER:  # one for each Python worker
        _SCANNER.append(LicenceScanner())
    for batch, texts in text_steps(batches):
        columns = list(zip(*[_SCANNER[0].scan(x or b"") for x in texts]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _TYPES)]], ["doc_id", *_NAMES])


def licence_scan(documents: DataFrame) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the
    expressions behind tags and whether each of them leaves a permissive choice (null without one)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanned, schema)
