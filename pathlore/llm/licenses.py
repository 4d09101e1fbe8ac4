"""License scans: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting-yard parser.

A text's words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. One automaton
over the words, joined by single spaces, finds every place of every notice phrase, overlapping ones
too; a second one, over the lower-cased text, finds identifier tags. What follows a tag, up to the
end of the line or the next tag, is read as a license expression as far as it goes: identifiers,
parentheses, 'or' below 'and' below 'with', in any case. Notices that stand side by side with
nothing but an 'or' or an 'and' and articles between them are read by the same parser.

A value is a permission: 1 grants everything, 0 nothing (``PERMISSIONS``, by the longest beginning
of the identifier; others ``UNKNOWN``). 'or' leaves the choice (the larger), 'and' binds to both (the
smaller), 'with' adds an exception, which lifts copyleft to ``EXCEPTION`` at least. An expression that
doesn't end well (an open parenthesis, an operator without its right side) counts as its licenses
joined by 'and' and is marked as not valid; one that begins with no license is none. A text's
score is the smallest value of its statements; that all rights are reserved counts only where no
other statement stands, and a text without any statement scores 0, as nothing grants anything.

A phrase's place inside that of a longer phrase is left out, but for places of base phrases, which
all stay. Nulls: a null text is an empty one. Texts of any length are read whole, in time and memory
that grow with their length. Rows are judged alone, so repeats don't matter. An empty table gives an
empty result. Other columns are passed on; one named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices


class Phrase(NamedTuple):
    words: str
    label: str
    base: bool = False


#: Phrases as they stand in license notices, and their labels.
BASE = [
    Phrase("under the mit license", "mit", True),
    Phrase("apache license version 2", "apache-2", True),
    Phrase("cc by nc", "cc-by-nc", True),
]
NOTICES = [
    Phrase("mit license", "mit"),
    Phrase("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Phrase("apache license version 2 0", "apache-2"),
    Phrase("apache license 2 0", "apache-2"),
    Phrase("apache 2 0 license", "apache-2"),
    Phrase("redistribution and use in source and binary forms", "bsd"),
    Phrase("bsd license", "bsd"),
    Phrase("bsd 2 clause license", "bsd-2-clause"),
    Phrase("bsd 3 clause license", "bsd-3-clause"),
    Phrase("isc license", "isc"),
    Phrase("permission to use copy modify and or distribute this software for any purpose", "isc"),
    Phrase("zlib license", "zlib"),
    Phrase("boost software license version 1 0", "bsl-1"),
    Phrase("gnu general public license", "gpl"),
    Phrase("gnu general public license version 2", "gpl-2"),
    Phrase("gnu general public license version 3", "gpl-3"),
    Phrase("gnu lesser general public license", "lgpl"),
    Phrase("gnu affero general public license", "agpl"),
    Phrase("mozilla public license", "mpl"),
    Phrase("mozilla public license version 2 0", "mpl-2"),
    Phrase("eclipse public license", "epl"),
    Phrase("this is free and unencumbered software released into the public domain", "unlicense"),
    Phrase("cc0 1 0 universal", "cc0"),
    Phrase("cc by 4 0", "cc-by"),
    Phrase("cc by sa", "cc-by-sa"),
    Phrase("cc by nd", "cc-by-nd"),
    Phrase("cc by nc sa", "cc-by-nc-sa"),
    Phrase("cc by nc nd", "cc-by-nc-nd"),
    Phrase("creative commons attribution", "cc-by"),
    Phrase("creative commons attribution sharealike", "cc-by-sa"),
    Phrase("creative commons attribution noncommercial", "cc-by-nc"),
    Phrase("creative commons attribution noncommercial sharealike", "cc-by-nc-sa"),
    Phrase("all rights reserved", "all-rights-reserved"),
]
TAGS = ["spdx-license-identifier:", "license-expression:", "@license "]
RESERVED = "all-rights-reserved"
#: What a license grants, by the beginning of its label.
PERMISSIONS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl-1": 1.0, "unlicense": 1.0, "cc0": 1.0,
    "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, RESERVED: 0.0,
}
UNKNOWN, EXCEPTION = 0.25, 0.7
#: Binding strength of the operators.
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Words that may stand beside 'or' and 'and' between two notices.
ARTICLES = {"the", "a", "an", "either", "both", "license", "licence", "under", "terms", "of", "version"}

PLACE = "struct<first:long,last:long,label:string,base:boolean>"
EXPRESSION = "struct<text:string,labels:array<string>,valid:boolean,permission:double>"
RESULT = f"struct<n_words:long,places:array<{PLACE}>,expressions:array<{EXPRESSION}>,score:double>"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(rb"  +")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+:_-]*[a-z0-9+])?)")


class Statement(NamedTuple):
    text: str
    labels: list[str]
    valid: bool
    permission: float


def label_of(identifier: str) -> str:
    """A license identifier without its version's trailing zero, 'only', 'or later' or '+'; of Creative Commons licenses without version."""
    own = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    own = re.sub(r"^(cc0|cc-[a-z-]+?)-\d.*$", r"\1", own)
    return re.sub(r"\.0$", "", own)


def permission(label: str) -> float:
    """By the longest beginning, up to a hyphen or the end, that the table has."""
    parts = label.split("-")
    for k in range(len(parts), 0, -1):
        if (found := PERMISSIONS.get("-".join(parts[:k]))) is not None:
            return found
    return UNKNOWN


def parse(tokens: Iterable[str]) -> Statement | None:
    """Reads tokens as far as they make an expression: two stacks, operators by strength; values are worked out as operators leave the stack."""
    values: list[float] = []
    operators: list[str] = []
    read: list[str] = []
    labels: list[str] = []
    depth, operand = 0, True  # whether an operand comes next

    def apply() -> None:
        op, right = operators.pop(), values.pop()
        left = values.pop()
        values.append(max(left, right) if op == "or" else min(left, right) if op == "and" else left if left in (0.0, UNKNOWN) else max(left, EXCEPTION))

    for token in tokens:
        if operand:
            after = operators[-1] if operators else ""
            if token == "(" and after != "with":
                operators.append(token)
                depth += 1
            elif token in "()" or token in STRENGTH:
                break
            else:
                if after == "with":
                    values.append(1.0)
                else:
                    labels.append(label_of(token))
                    values.append(permission(labels[-1]))
                operand = False
        elif token == ")":
            if not depth:
                break
            while operators[-1] != "(":
                apply()
            operators.pop()
            depth -= 1
        elif token in STRENGTH:
            while operators and STRENGTH.get(operators[-1], 0) >= STRENGTH[token]:
                apply()
            operators.append(token)
            operand = True
        else:
            break
        read.append(token)
    if not labels:
        return None
    text = re.sub(r"\( | (?=\))", lambda m: m[0].strip(), " ".join(read))
    if operand or depth:
        return Statement(text, labels, False, min(map(permission, labels)))
    while operators:
        apply()
    return Statement(text, labels, True, values[0])


def tokens(text: str, start: int, stop: int) -> Iterator[str]:
    """Parentheses and identifiers from a place on, up to anything else."""
    while (m := _TOKEN.match(text, start, stop)) is not None:
        yield m[1]
        start = m.end()


class Place(NamedTuple):
    first: int
    last: int
    label: str
    base: bool


class Scanner:
    def __init__(self, phrases: list[Phrase], tags: list[str]):
        self.phrases, self.notices, self.tags = phrases, ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            self.notices.add_word(f" {p.words} ", i)
        for t in tags:
            self.tags.add_word(t, len(t))
        self.sizes = [len(p.words.split()) for p in phrases]
        for a in (self.notices, self.tags):
            a.make_automaton()

    def places(self, joined: str) -> list[Place]:
        """All places of all phrases in words that single spaces join and surround, by their first word, the longer first."""
        hits = sorted((end - len(self.phrases[i].words) - 1, -self.sizes[i], i) for end, i in self.notices.iter(joined)) if len(self.notices) else []
        out, at, word = [], 0, -1
        for start, _, i in hits:
            word += joined.count(" ", at, start + 1)
            at = start + 1
            out.append(Place(word, word + self.sizes[i] - 1, self.phrases[i].label, self.phrases[i].base))
        return out

    def notices_of(self, places: list[Place], joined: str) -> list[Statement]:
        """The statements of places that aren't inside another one; neighbours that are joined by 'or' or 'and' are one."""
        out: list[Statement] = []
        run: list[str] = []
        words = iter(re.finditer(r"[^ ]+", joined))
        last, at = -1, 0
        for p in places:
            if p.last <= last:
                continue
            between = []
            if run and last < p.first <= last + 5:
                while at <= last:
                    next(words)
                    at += 1
                while at < p.first:
                    between.append(next(words)[0])
                    at += 1
            joint = [w for w in between if w in ("or", "and")]
            if len(joint) == 1 and ARTICLES.issuperset(w for w in between if w != joint[0]):
                run += [joint[0], p.label]
            else:
                if run:
                    out.append(parse(run))
                run = [p.label]
            last = p.last
        if run:
            out.append(parse(run))
        return out

    def tagged(self, text: str) -> list[Statement]:
        """The statements behind identifier tags of a lower-cased text."""
        hits = [(end + 1 - size, end + 1) for end, size in self.tags.iter(text)] if len(self.tags) else []
        out = []
        for k, (_, at) in enumerate(hits):
            stop = hits[k + 1][0] if k + 1 < len(hits) else len(text)
            if (own := parse(tokens(text, at, max(at, stop)))) is not None:
                out.append(own)
        return out

    def scan(self, text: bytes | None) -> dict:
        data = text or b""
        words = _SPACES.sub(b" ", data.translate(_TABLE)).strip(b" ")
        joined = f" {words.decode('utf-8', 'replace')} " if words else ""
        found = self.places(joined)
        statements = self.tagged(data.translate(_LOWER).decode("utf-8", "replace")) + self.notices_of(found, joined)
        binding = [s.permission for s in statements if s.labels != [RESERVED]]
        kept, last = [], -1
        for p in found:
            if p.base or p.last > last:
                kept.append(p._asdict())
            last = max(last, p.last)
        score = min(binding) if binding else 0.0
        return {"n_words": words.count(b" ") + 1 if words else 0, "places": kept, "expressions": [s._asdict() for s in statements], "score": score}


def scan(docs: DataFrame, name: str = "_licenses", base: list[Phrase] = BASE, notices: list[Phrase] = NOTICES, tags: list[str] = TAGS) -> DataFrame:
    """``docs`` with what their texts say of licenses as a last column ``name``: number of words, places of phrases, statements, score."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    fields = [*(docs.schema[c] for c in kept)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` {RESULT}"])
    place = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
    expression = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("valid", pa.bool_()), ("permission", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("expressions", pa.list_(expression)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner([*base, *notices], tags)
        for b in slices(batches, "text"):
            found = pa.array(map(scanner.scan, b.column("text").cast(pa.binary()).to_pylist()), kind, size=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), found], [*kept, name])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def label_list(labels: Column) -> Column:
    """Distinct labels, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(licenses: Column) -> list[Column]:
    """Columns of one row for each text from ``scan``'s result."""
    base = F.filter(licenses.places, lambda p: p.base)
    first = F.transform(base, lambda p: p.first)
    stated = F.flatten(F.transform(licenses.expressions, lambda e: e.labels))
    return [
        licenses.n_words.alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        label_list(F.transform(base, lambda p: p.label)).alias("base_labels"),
        label_list(F.concat(F.transform(licenses.places, lambda p: p.label), stated)).alias("labels"),
        licenses.score.alias("score"),
        F.array_join(F.transform(licenses.expressions, lambda e: e.text), "; ").alias("expressions"),
        F.size(F.filter(licenses.expressions, lambda e: ~e.valid)).cast("long").alias("n_malformed"),
    ]
