"""English full text: lexemes with their places, a total query parser, a match predicate, and a rank.

A text's lexemes are its lower-case tokens, stemmed, without stop words; a place counts all tokens, from 1, stop words included. A query in web-search
syntax becomes alternatives of lexemes and phrases that must, or must not, occur. The rank is that of the public PostgreSQL source (`ts_rank` with its
default weights): for one lexeme or several alternatives the mean of 1/1 + 1/4 + 1/9 ... over each lexeme's occurrences, for a conjunction or phrase what the
distances between the places of each two lexemes give. With `simple` every token is its own lexeme."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.english import STOP, Stems

SEPARATOR = r"[^\p{L}\p{N}]+"
TOKEN = re.compile(r"[^\W_]+")
# Fixed values of the rank: places kept of a lexeme, the last place, the weight of an occurrence, the sum of 1/n^2.
PLACES, LAST, WEIGHT, SQUARES = 255, 16383, 0.1, 1.64493406685
#: Offset of each lexeme from the first one.
Phrase = tuple[tuple[int, str], ...]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")


def places(text: str, stems: dict[str, str | None] | None) -> dict[str, list[int]]:
    """Each lexeme's places; stems: None for `simple`."""
    found: dict[str, list[int]] = {}
    for at, token in enumerate(TOKEN.findall(text.lower()), 1):
        lexeme = token if stems is None else stems[token]
        if lexeme is not None:
            mine = found.setdefault(lexeme, [])
            if len(mine) < PLACES and (not mine or mine[-1] < LAST):
                mine.append(min(at, LAST))
    return found


@dataclass(frozen=True)
class Clause:
    """One alternative: phrases (a word is a phrase of one) that must and must not occur."""

    must: tuple[Phrase, ...]
    never: tuple[Phrase, ...]


def parse(query: str | None, simple: bool = False) -> list[Clause]:
    """Web-search syntax: words, "phrases", or, -not. Any text parses. Stop words go, and so does what is made of them alone; a query of nothing else matches nothing."""
    stems = None if simple else Stems()
    found, must, never = [], [], []
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        word = quoted or bare
        if not sign and not quoted and bare.lower() == "or":
            found.append(Clause(tuple(must), tuple(never)))
            must, never = [], []
            continue
        each = [(i, t if stems is None else stems[t]) for i, t in enumerate(TOKEN.findall(word.lower()))]
        if kept := [(i, x) for i, x in each if x is not None]:
            (never if sign else must).append(tuple((i - kept[0][0], x) for i, x in kept))
    found.append(Clause(tuple(must), tuple(never)))
    return [c for c in found if c.must or c.never]


def lexemes(clauses: list[Clause]) -> list[str]:
    return sorted({x for c in clauses for p in c.must + c.never for _, x in p})


def needs_any(clauses: list[Clause]) -> bool:
    """Whether what matches has one of the lexemes; an alternative of exclusions alone needs none."""
    return all(c.must for c in clauses)


def located(rows: DataFrame, wanted: list[str], text: str = "content", simple: bool = False) -> DataFrame:
    """The rows with, instead of the text, `at`: the places of each wanted lexeme. For reads without an index: every text is split."""
    others = [f for f in rows.schema.fields if f.name != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = None if simple else Stems()
        number = {x: i for i, x in enumerate(wanted)}
        for batch in batches:
            at = []
            for t in batch.column(text).to_pylist():
                mine: list[list[int]] = [[] for _ in wanted]
                for lexeme, where in places(t or "", stems).items():
                    if lexeme in number:
                        mine[number[lexeme]] = where
                at.append(mine)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(at, pa.list_(pa.list_(pa.int32())))], [*(f.name for f in others), "at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(work, f"{kinds}, at array<array<int>>")


def _has(at: Column, phrase: Phrase, number: dict[str, int]) -> Column:
    first = at[number[phrase[0][1]]]
    if len(phrase) == 1:
        return F.size(first) > 0
    return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(at[number[x]], p + i) for i, x in phrase[1:]]))


def matches(at: Column, clauses: list[Clause]) -> Column:
    """at: the places of each of lexemes(clauses)."""
    number = {x: i for i, x in enumerate(lexemes(clauses))}
    every = [reduce(lambda a, b: a & b, [_has(at, p, number) for p in c.must] + [~_has(at, p, number) for p in c.never]) for c in clauses]
    return reduce(lambda a, b: a | b, every) if every else F.lit(False)


def _near(distance: int) -> float:
    """ln(1 - what two occurrences so far apart add)."""
    return math.log1p(-WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2)))) if distance else 0.0


def rank(at: Column, clauses: list[Clause]) -> Column:
    """To 9 decimals. Occurrences more than 100 tokens apart add less than that."""
    wanted = lexemes(clauses)
    several = len(clauses) == 1 and sum(len(p) for p in clauses[0].must + clauses[0].never) > 1
    if not several or len(wanted) < 2:
        sums = [0.0]
        for n in range(1, PLACES + 1):
            sums.append(sums[-1] + 1 / n**2)
        table = F.array(*map(F.lit, sums))
        each = [F.element_at(table, F.size(at[i]) + 1) for i in range(len(wanted))]
        return F.round(reduce(lambda a, b: a + b, each, F.lit(0.0)) * (WEIGHT / SQUARES / max(1, len(wanted))), 9)
    table = F.array(*[F.lit(_near(d)) for d in range(101)])

    def gain(a: Column, b: Column) -> Column:
        return F.when(F.abs(a - b) <= 100, F.element_at(table, F.abs(a - b) + 1)).otherwise(0.0)

    def pair(one: Column, other: Column) -> Column:
        return F.aggregate(one, F.lit(0.0), lambda s, a: s + F.aggregate(other, F.lit(0.0), lambda t, b: t + gain(a, b)))

    total = reduce(lambda a, b: a + b, [pair(at[i], at[k]) for i in range(len(wanted)) for k in range(i)])
    return F.round(1 - F.exp(total), 9)


__all__ = ["STOP", "Clause", "lexemes", "located", "matches", "needs_any", "parse", "places", "rank", "tokens"]
