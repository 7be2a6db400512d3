"""License scan: Aho-Corasick finds phrases and tags, a shunting-yard parser evaluates licence expressions.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. Texts are laid end to end with one
space between words and a line feed between texts, a bounded chunk at a time; one automaton holds all notice phrases
and tag words, and a match counts where it starts and ends at a word's edge. A tag (``SPDX-License-Identifier:``,
``license =`` and the like) is followed in the text itself by a licence expression: identifiers joined by ``AND``,
``OR``, ``WITH`` and brackets. ``WITH`` binds closest, then ``AND``, then ``OR``. The expression ends where the next
token cannot go on with it.

An expression's burden is its cheapest way out: the least of alternatives under ``OR``, the most under ``AND``; an
exception under ``WITH`` takes a licence down by one step. ``score`` is the largest burden of a text's phrases and
expressions: 0 for a text without any, 1 for the most restrictive.

Defined cases: a null or empty text has no word, no place, no label and score 0; a null doc_id and repeated rows come
back as they are, one row each; an unknown identifier counts after an SPDX tag (label: the identifier in lower case,
burden ``UNKNOWN``) and voids the expression after any other tag; an expression with an unclosed bracket or a missing
operand counts for nothing. Phrases that overlap all count, each start once per label. Texts of any length are read in
chunks of ``CHUNK`` bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.bytesets import pieces, text_buffer, tidy

CHUNK = 1 << 20
PERMISSIVE, WEAK, STRONG, CLOSED = 0.25, 0.5, 0.75, 1.0
UNKNOWN = STRONG
STEPS = (PERMISSIVE, WEAK, STRONG, CLOSED)


@dataclass(frozen=True)
class Licence:
    label: str
    burden: float
    names: tuple[str, ...]  # as identifiers, lower case, without "-only", "-or-later" or "+"
    phrases: tuple[str, ...]  # words as they stand in a notice


#: The phrases of the three base labels; every place of one counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

LICENCES = (
    Licence("mit", PERMISSIVE, ("mit", "mit-0", "x11", "expat"), ("permission is hereby granted free of charge to any person obtaining a copy",)),
    Licence("apache-2", PERMISSIVE, ("apache-2.0", "apache-2", "apache2"), ("www apache org licenses license 2 0",)),
    Licence("bsd-2", PERMISSIVE, ("bsd-2-clause", "bsd-2"), ("bsd 2 clause license", "simplified bsd license")),
    Licence("bsd-3", PERMISSIVE, ("bsd-3-clause", "bsd-3", "bsd"), ("bsd 3 clause license", "new bsd license", "modified bsd license")),
    Licence("isc", PERMISSIVE, ("isc",), ("under the isc license",)),
    Licence("zlib", PERMISSIVE, ("zlib",), ("under the zlib license",)),
    Licence("boost-1", PERMISSIVE, ("bsl-1.0",), ("boost software license version 1",)),
    Licence("unlicense", PERMISSIVE, ("unlicense",), ("this is free and unencumbered software released into the public domain",)),
    Licence("cc0-1", PERMISSIVE, ("cc0-1.0", "cc0"), ("cc0 1 0 universal", "creative commons zero")),
    Licence("cc-by", PERMISSIVE, ("cc-by-4.0", "cc-by-3.0", "cc-by"), ("creative commons attribution 4", "creative commons attribution 3", "cc by 4", "cc by 3")),
    Licence("cc-by-sa", WEAK, ("cc-by-sa-4.0", "cc-by-sa-3.0", "cc-by-sa"), ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike")),
    Licence("cc-by-nd", STRONG, ("cc-by-nd-4.0", "cc-by-nd"), ("cc by nd", "creative commons attribution noderivatives")),
    Licence(
        "cc-by-nc", CLOSED, ("cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "cc-by-nc"),
        ("creative commons attribution noncommercial", "creative commons attribution non commercial"),
    ),
    Licence("mpl-2", WEAK, ("mpl-2.0", "mpl-2"), ("mozilla public license version 2", "mozilla public license v 2")),
    Licence("epl-2", WEAK, ("epl-2.0", "epl-1.0"), ("eclipse public license",)),
    Licence("lgpl-2", WEAK, ("lgpl-2.0", "lgpl-2.1"), ("gnu lesser general public license version 2", "gnu library general public license")),
    Licence("lgpl-3", WEAK, ("lgpl-3.0",), ("gnu lesser general public license version 3",)),
    Licence("gpl-2", STRONG, ("gpl-2.0",), ("gnu general public license version 2", "gnu general public license v2")),
    Licence("gpl-3", STRONG, ("gpl-3.0",), ("gnu general public license version 3", "gnu general public license v3")),
    Licence("agpl-3", CLOSED, ("agpl-3.0",), ("gnu affero general public license",)),
    Licence("all-rights-reserved", CLOSED, (), ("all rights reserved",)),
)
#: Words of the tags; after an SPDX tag any identifier counts.
SPDX_TAGS = ("spdx license identifier", "spdx license expression")
TAGS = (*SPDX_TAGS, "license", "licence", "license expression", "licenses")

BURDEN = {x.label: x.burden for x in LICENCES}
BY_NAME = {name: x for x in LICENCES for name in x.names}
_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))
_MARK = 10  # between texts; every separator inside a text is folded to a space
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([A-Za-z0-9][A-Za-z0-9.+:-]*|[()])")
_BINDS = {"or": 1, "and": 2, "with": 3}


def tokens(raw: bytes | memoryview, at: int, end: int) -> Iterator[str]:
    """Lower-case tokens from ``at`` on, up to the first byte that starts none."""
    while found := _TOKEN.match(raw, at, end):
        yield bytes(found[1]).decode().lower()
        at = found.end()


def postfix(stream: Iterator[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in evaluation order; None where a bracket or an operand is missing."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether one must come next
    for token in stream:
        if operand:
            if token == "(":
                waiting.append(token)
            elif token in _BINDS or token == ")":
                return None
            else:
                out.append(token.rstrip(".:"))
                operand = False
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            break
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def identify(name: str) -> Licence | None:
    for ending in ("+", "-or-later", "-only"):
        name = name.removesuffix(ending)
    return BY_NAME.get(name)


def evaluate(steps: list[str], *, any_name: bool) -> tuple[list[str], float, str] | None:
    """(labels, burden, expression written out) of a postfix expression; None where a name must be known and is not."""
    stack: list[tuple[list[str], float, str]] = []
    exceptions = {k - 1 for k, s in enumerate(steps) if s == "with"}  # what stands before ``with`` is no licence
    for k, step in enumerate(steps):
        if step in _BINDS:
            (more, right, last), (labels, left, first) = stack.pop(), stack.pop()
            if step == "with":
                burden = STEPS[max(0, STEPS.index(left) - 1)]
            else:
                burden = min(left, right) if step == "or" else max(left, right)
            stack.append((labels + more, burden, f"({first} {step} {last})"))
        elif k in exceptions:
            stack.append(([], 0.0, step))
        elif (found := identify(step)) is not None:
            stack.append(([found.label], found.burden, step))
        elif any_name:
            stack.append(([step], UNKNOWN, step))
        else:
            return None
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """All phrases and tags; a value is a list of (kind, label) where kind is base, phrase, tag or spdx."""
    held: dict[str, list[tuple[str, str]]] = {}
    for phrase, label in BASE.items():
        held.setdefault(phrase, []).append(("base", label))
    for licence in LICENCES:
        for phrase in licence.phrases:
            held.setdefault(phrase, []).append(("phrase", licence.label))
    for tag in TAGS:
        held.setdefault(tag, []).append(("spdx" if tag in SPDX_TAGS else "tag", tag))
    found = ahocorasick.Automaton()
    for phrase, values in held.items():
        found.add_word(phrase, (len(phrase), values))
    found.make_automaton()
    return found


LONGEST = max(map(len, [*BASE, *TAGS, *(p for x in LICENCES for p in x.phrases)]))


class Stream:
    """Texts laid end to end, folded to words and single spaces, in views that overlap by the longest phrase."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        self.words = np.zeros(len(offsets) - 1, np.int64)  # words per text
        self.first = np.zeros(len(offsets), np.int64)  # words of all texts before

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(folded bytes with a mark before each text, place of each byte in ``raw``)."""
        end, starts = len(self.raw), self.offsets[:-1]
        for a in range(0, max(end, 1), CHUNK):
            b = min(a + CHUNK, end)
            folded = np.frombuffer(self.raw[a:b].tobytes().translate(_FOLD), np.uint8)
            here = np.searchsorted(starts, [a, b if b < end else b + 1])
            marks = starts[here[0] : here[1]]
            yield np.insert(folded, marks - a, _MARK), np.insert(np.arange(a, b), marks - a, marks)
        yield np.array([_MARK], np.uint8), np.array([end])

    def views(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(bytes, places, word number of each byte, text of each byte, first byte not met before)."""
        view = places = words = texts = None
        word, text = 0, -1
        for folded, at in self._chunks():
            before = np.r_[view[-1] if view is not None else np.uint8(_MARK), folded[:-1]]
            keep = (folded != 32) | (before > 32)
            folded, at, before = folded[keep], at[keep], before[keep]
            starts = (folded > 32) & (before <= 32)
            mark = folded == _MARK
            number = word + np.cumsum(starts)
            owner = text + np.cumsum(mark)
            if len(folded):
                known = owner[mark]
                self.first[known] = number[mark]
                word, text = int(number[-1]), int(owner[-1])
            held = 0 if view is None else min(len(view), LONGEST + 2)
            if held:
                view, places = np.r_[view[-held:], folded], np.r_[places[-held:], at]
                words, texts = np.r_[words[-held:], number], np.r_[texts[-held:], owner]
            else:
                view, places, words, texts = folded, at, number, owner
            yield view.tobytes(), places, words, texts, held
        self.words = np.diff(self.first)


def matches(raw: np.ndarray, offsets: np.ndarray, machine: ahocorasick.Automaton) -> tuple[np.ndarray, list[tuple]]:
    """Words per text, and (text, word, kind, label, place in ``raw`` behind it) of every match at word edges."""
    stream, found = Stream(raw, offsets), []
    for view, places, words, texts, held in stream.views():
        for last, (length, values) in machine.iter(view.decode("latin-1")):
            start = last - length + 1
            # A match is taken in the one view that first shows the byte behind it.
            if last + 1 >= len(view) or last + 1 < held or start == 0 or view[start - 1] > 32 or view[last + 1] > 32:
                continue
            text = int(texts[start])
            for kind, label in values:
                found.append((text, int(words[start]) - 1 - int(stream.first[text]), kind, label, int(places[last]) + 1))
    return stream.words, found


SCHEMA = (
    "doc_id {kind}, n_words long, places array<struct<word: long, label: string, base: boolean>>, "
    "labels array<string>, expressions array<string>, score double"
)


def scan(documents: DataFrame) -> DataFrame:
    """Per document: its words, the places of all phrases, its distinct labels, its expressions and its score."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets):
                text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words, found = matches(text, at, machine)
                places: list[list] = [[] for _ in range(j - i)]
                labels: list[list] = [[] for _ in range(j - i)]
                written: list[list] = [[] for _ in range(j - i)]
                scores = np.zeros(j - i)
                seen = memoryview(text)
                for k, word, what, label, behind in found:
                    if what in ("base", "phrase"):
                        places[k].append({"word": word, "label": label, "base": what == "base"})
                        labels[k].append(label)
                        scores[k] = max(scores[k], BURDEN[label])
                        continue
                    end = int(at[k + 1])
                    colon = _AFTER_TAG.match(seen, behind, end)
                    steps = postfix(tokens(seen, colon.end(), end)) if colon else None
                    value = evaluate(steps, any_name=what == "spdx") if steps else None
                    if value:
                        labels[k] += value[0]
                        written[k].append(value[2])
                        scores[k] = max(scores[k], value[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(words),
                     pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
                     pa.array([sorted(set(v)) for v in labels], pa.list_(pa.string())),
                     pa.array([sorted(set(v)) for v in written], pa.list_(pa.string())), pa.array(scores)],
                    ["doc_id", "n_words", "places", "labels", "expressions", "score"],
                )

    return documents.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA.format(kind=kind))
