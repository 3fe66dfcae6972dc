"""Boolean literature searches as Spark predicates, in two dialects.

Web dialect: TS=(...), TI=(...) with AND, OR, NOT, quoted phrases and * for
truncation. Chinese dialect: FIELD op 'value' with the operators = (equal),
% and %= (contained), the in-field signs * (and), + (or), - (not), YE BETWEEN
('2019','2024'), and AND, OR, NOT between fields. Words compare without case.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"""\s*(?:(?P<between>[A-Z]{2,3}\s+BETWEEN\s*\(\s*'[^']*'\s*,\s*'[^']*'\s*\))|(?P<field>[A-Z]{2,3})\s*(?P<op>%=|=|%)|(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|'(?P<value>[^']*)'|(?P<word>[^\s()"']+))""")


class SearchError(ValueError):
    """A search that cannot be read, with the place."""


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _TOKENS.match(text, at)
        if not found or found.end() == at:
            raise SearchError(f"unreadable at {at}: {text[at : at + 20]!r}")
        kind = found.lastgroup
        if kind == "op":
            out.append(("field", f"{found['field']} {found['op']}", at))
        else:
            value = found[kind]
            if kind == "word" and value.upper() in ("AND", "OR", "NOT"):
                out.append((value.upper(), value, at))
            else:
                out.append((kind, value, at))
        at = found.end()
    return out


def word_pattern(term: str) -> str:
    """A Java pattern for a word or phrase; * stands for any ending."""
    parts = [re.sub(r"([\\^$.|?+()\[\]{}])", r"\\\1", part) for part in term.lower().split("*")]
    body = r"[\p{L}\p{N}]*".join(parts)
    return r"(?<![\p{L}\p{N}])" + body + r"(?![\p{L}\p{N}])"


class _Parser:
    def __init__(self, text: str, test: Callable[[str, str], Column], between: Callable[[str, str, str], Column]) -> None:
        self.tokens, self.at, self.test, self.between = _tokens(text), 0, test, between
        self.field = "TS ="

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self) -> tuple[str, str, int]:
        token = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", -1)
        self.at += 1
        return token

    def either(self) -> Column:
        left = self.both()
        while self.peek() == "OR":
            self.take()
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.unary()
        while self.peek() not in ("end", "close", "OR"):
            negated = False
            if self.peek() in ("AND", "NOT"):
                negated = self.take()[0] == "NOT"
            if not negated and self.peek() == "NOT":
                self.take()
                negated = True
            right = self.unary()
            left = left & (~right if negated else right)
        return left

    def unary(self) -> Column:
        kind, value, place = self.take()
        if kind == "NOT":
            return ~self.unary()
        if kind == "open":
            inner = self.either()
            if self.take()[0] != "close":
                raise SearchError(f"a parenthesis opened at {place} is not closed")
            return inner
        if kind == "field":
            before, self.field = self.field, value
            inner = self.unary()
            self.field = before
            return inner
        if kind == "between":
            name, low, high = re.match(r"([A-Z]+)\s+BETWEEN\s*\(\s*'([^']*)'\s*,\s*'([^']*)'", value).groups()
            return self.between(name, low, high)
        if kind in ("word", "phrase", "value"):
            return self.test(self.field, value)
        raise SearchError(f"nothing to search for at {place}")


def _read(text: str, test: Callable[[str, str], Column], between: Callable[[str, str, str], Column]) -> Column:
    parser = _Parser(text, test, between)
    if not parser.tokens:
        raise SearchError("an empty search")
    out = parser.either()
    if parser.peek() != "end":
        raise SearchError(f"unexpected {parser.take()[1]!r}")
    return out


def web_search(text: str, title: Column, topic: Column) -> Column:
    """The predicate of a web-dialect search; TI looks at the title, TS at the topic."""

    def test(field: str, term: str) -> Column:
        where = title if field.startswith("TI") else topic
        return F.coalesce(F.lower(where).rlike(word_pattern(term)), F.lit(False))

    return _read(text, test, lambda *_: F.lit(False))


def cnki_search(text: str, fields: dict[str, list[Column]], year: Column) -> Column:
    """The predicate of a Chinese-dialect search; fields maps a code (SU, TI, ...) to the columns it looks at."""

    def one(field: str, term: str) -> Column:
        code, op = field.split()
        if code not in fields:
            raise SearchError(f"unknown field {code}")
        tests = [F.coalesce(F.lower(column) == term.lower() if op == "=" else F.contains(F.lower(column), F.lit(term.lower())), F.lit(False)) for column in fields[code]]
        out = tests[0]
        for other in tests[1:]:
            out = out | other
        return out

    def test(field: str, value: str) -> Column:
        out: Column | None = None
        sign = "+"
        for part in re.split(r"\s*([*+-])\s*", value):
            if part in ("*", "+", "-"):
                sign = part
            elif part:
                term = one(field, part)
                out = term if out is None else out & term if sign == "*" else out & ~term if sign == "-" else out | term
        if out is None:
            raise SearchError("an empty value")
        return out

    return _read(text, test, lambda name, low, high: F.coalesce(year.between(int(low), int(high)), F.lit(False)))


def ambiguous_terms(text: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The terms of a search text that stand outside the phrases that make them clear."""
    out = []
    for term, phrases in terms.items():
        rest = F.lower(text)
        for phrase in phrases:
            rest = F.replace(rest, F.lit(phrase.lower()), F.lit(" "))
        out.append(F.when(rest.rlike(word_pattern(term)), F.lit(term)))
    return F.array_compact(F.array(*out))
