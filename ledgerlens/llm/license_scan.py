"""Licence scans: notice phrases and identifier tags by Aho-Corasick automata, expressions by shunting-yard.

One automaton runs over the text's lower-case words joined by one space and
finds notice phrases at word bounds.  A second one runs over the text itself
and finds identifier tags; the rest of a tag's line is read as a licence
expression with and, or, with and parentheses, put into postfix order by a
shunting-yard parser and evaluated to the licences that it names and whether
a permissive choice satisfies it.  Of a line that goes on after its
expression (a full stop, prose), the longest leading part that is one counts.
Identifiers and exceptions outside the tables are labels too, and whether they
are permissive is unknown; in a line that goes on, a plain word is prose.

The score is the strongest evidence: 1 for an expression, the phrase's weight
otherwise, 0 without any.  Null texts count as empty.  Rows are independent,
so repeated rows and ids give equal rows; an empty table gives none.  Other
columns are left out unless ``keep`` names them, and a kept column called
like a new one gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches

#: The base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The method's own phrases: label and weight (fixed values).
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "isc license": ("isc", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by 4 0": ("cc-by-4.0", 0.9),
    "cc by sa 4 0": ("cc-by-sa-4.0", 0.9),
    "cc by nc 4 0": ("cc-by-nc-4.0", 0.9),
    "cc0 1 0": ("cc0-1.0", 0.9),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT = 0.7

TAGS = ("spdx-license-identifier:", '"license":', "license-expression:")

#: Identifiers that expressions may name, and whether they are permissive (fixed values).
IDENTIFIERS = {
    "0bsd": True, "agpl-3.0": False, "apache-2.0": True, "bsd-2-clause": True, "bsd-3-clause": True, "cc-by-4.0": True,
    "cc-by-sa-4.0": False, "cc-by-nc-4.0": False, "cc0-1.0": True, "epl-2.0": False, "gpl-2.0": False, "gpl-3.0": False, "isc": True,
    "lgpl-2.1": False, "lgpl-3.0": False, "mit": True, "mpl-2.0": False, "unlicense": True, "zlib": True,
}
#: Exceptions that may follow `with`, and whether linking under them is permissive (fixed values).
EXCEPTIONS = {"classpath-exception-2.0": True, "gcc-exception-3.1": True, "llvm-exception": True, "autoconf-exception-3.0": False}

#: Operands that name no licence (fixed values).
NO_LICENCE = {"none", "noassertion", "unknown"}

BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[a-z0-9.+-]+|[()]")
#: What an expression consists of, up to a full stop.
_LEADING = re.compile(r"(?:[a-z0-9+()\s-]|\.(?!\s|$))*")
_NAME = re.compile(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\+?")
_SLASHES = re.compile(r"[a-z0-9][a-z0-9.+-]*(?:/[a-z0-9][a-z0-9.+-]*)+(?<![.])")
_BREAK = bytes(b if W.ALNUM[b] else 0x20 for b in W.LOWER.tolist())


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in evaluation order; None if the order of tokens is no expression."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                return None
            stack.pop()
        elif t in BINDING:
            if operand:
                return None
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def _all(a: bool | None, b: bool | None) -> bool | None:
    """And, where None is unknown."""
    return False if a is False or b is False else None if a is None or b is None else True


def _any(a: bool | None, b: bool | None) -> bool | None:
    return True if a or b else None if a is None or b is None else False


def _base(t: str) -> str:
    return re.sub(r"(-only|-or-later|\+)$", "", t)


def evaluate(expression: str) -> tuple[set[str], bool | None] | None:
    """The licences that an expression names, and whether a permissive choice satisfies it (None: unknown); None if it is no expression."""
    tokens = _TOKEN.findall(expression.lower())
    order = postfix(tokens)
    if not order:
        return None
    stack: list[tuple[set[str], bool | None, str]] = []
    for t in order:
        if t in BINDING:
            (b, free_b, name_b), (a, free_a, _) = stack.pop(), stack.pop()
            if t == "with":
                if name_b not in EXCEPTIONS and (not name_b or _base(name_b) in IDENTIFIERS):
                    return None
                stack.append((a | b, _any(free_a, EXCEPTIONS.get(name_b)), ""))
            else:
                if name_b in EXCEPTIONS:
                    return None
                stack.append((a | b, _any(free_a, free_b) if t == "or" else _all(free_a, free_b), ""))
        elif t in EXCEPTIONS:
            stack.append((set(), False, t))
        elif t in NO_LICENCE:
            stack.append((set(), None, t))
        elif not _NAME.fullmatch(t):
            return None
        else:
            stack.append(({_base(t)}, IDENTIFIERS.get(_base(t)), t))
    names, free, name = stack.pop()
    return (names, free) if names and name not in EXCEPTIONS else None


def leading(line: str) -> str:
    """The longest leading part of a lower-case line that is an expression; a slash between known identifiers is an or."""
    line = _SLASHES.sub(lambda m: " or ".join(m[0].split("/")) if all(_base(x) in IDENTIFIERS for x in m[0].split("/")) else m[0], line)
    part = _LEADING.match(line)[0]
    tokens = list(_TOKEN.finditer(part))
    for prose in (False, True):
        depth, operand, end, whole = 0, True, 0, False
        for m in tokens:
            t = m[0]
            if t == "(":
                if not operand:
                    break
                depth += 1
            elif t == ")":
                if operand or not depth:
                    break
                depth -= 1
            elif t in BINDING:
                if operand:
                    break
                operand = True
            else:
                plain = t.isalpha() and t not in IDENTIFIERS
                if not operand or not _NAME.fullmatch(t) or prose and plain:
                    break
                operand = False
            if not depth and not operand:
                end = m.end()
        else:
            whole = not line[end:].strip(" \t\r.")
        if whole:
            break
    return line[:end]


def _automaton(keys: dict) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, v in keys.items():
        found.add_word(k, v)
    found.make_automaton()
    return found


class Scanner:
    def __init__(self):
        phrases = {f" {p} ": (p, label, BASE_WEIGHT, True) for p, label in BASE.items()}
        phrases |= {f" {p} ": (p, label, weight, False) for p, (label, weight) in NOTICES.items()}
        self.phrases, self.tags = _automaton(phrases), _automaton({t: t for t in TAGS})

    def scan(self, raw: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, permissive, score of a text's UTF-8 bytes."""
        words = raw.translate(_BREAK).split()
        joined = " " + b" ".join(words).decode() + " "
        n_base, first, last, score, base, labels, frees = 0, None, None, 0.0, set(), set(), []
        at, word = 0, 0
        starts = []
        for end, (phrase, label, weight, is_base) in self.phrases.iter(joined):
            labels.add(label)
            score = max(score, weight)
            if is_base:
                n_base += 1
                base.add(label)
                starts.append(end - len(phrase) - 1)
        for start in sorted(starts):  # spaces up to a phrase's first one are the words before it
            word, at = word + joined.count(" ", at, start), start
            first, last = (word if first is None else first), word
        lower = raw.translate(W.LOWER.tobytes()).decode()
        for end, _ in self.tags.iter(lower):
            stop = lower.find("\n", end)
            line = lower[end + 1:len(lower) if stop < 0 else stop]
            line = re.split(r'"\s*[,}]|\*/|-->', line.strip().strip('"'))[0]
            # a line whose names are all known may have other characters between them
            got = evaluate(line)
            if not got or not got[0] <= IDENTIFIERS.keys():
                got = evaluate(leading(line))
            if got:
                labels |= got[0]
                frees.append(got[1])
                score = 1.0
        free = reduce(_all, frees) if frees else None
        return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), free, score)


FOUND = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
         ("base_labels", T.StringType()), ("labels", T.StringType()), ("permissive", T.BooleanType()), ("score", T.DoubleType())]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and those of ``FOUND``; permissive: whether every expression has a permissive choice, null without one or if it is unknown."""
    names = [n for n, _ in FOUND]
    own = [c for c in dict.fromkeys(keep) if c not in names]
    bound_batches(docs.sparkSession)
    source = docs.select(*own, docs[text].cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in own] + [T.StructField(n, k) for n, k in FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]
        for batch in batches:
            buf, bounds = W.text_bytes(batch.column("__text"))
            found = [scanner.scan(buf[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + columns, names=[*own, *names])

    return source.mapInArrow(run, schema)
