"""Full-text search over token arrays: query syntaxes, matching and cover-density rank.

A text's tokens are its runs of letters, digits and underscores in lower case, in
order.  A query becomes a tree of terms, phrases, AND, OR and NOT.  Matching is a
column expression.  The rank sums, over the smallest extents of a text that
satisfy the query, 0.1 / (1 + words in between) (Clarke, Cormack and Tudhope's
cover density at equal weights).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
WEIGHT = 0.1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def split_tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@dataclass(frozen=True)
class Phrase:
    """Words at successive places; one word is a term."""

    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def _and(parts: list):
    return parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else None


def parse(query: str, syntax: str):
    """The query tree; None where no token is left, which matches nothing."""
    if syntax == "plain":
        return _and([Phrase((w,)) for w in split_tokens(query)])
    if syntax == "phrase":
        words = split_tokens(query)
        return Phrase(tuple(words)) if words else None
    groups: list[list] = [[]]
    for quoted, bare in re.findall(r'(-?"[^"]*"?)|(\S+)', query):
        item = quoted or bare
        if item.lower() == "or" and groups[-1]:
            groups.append([])
            continue
        negative = item.startswith("-")
        words = split_tokens(item)
        if words:
            part = Phrase(tuple(words))
            groups[-1].append(Not(part) if negative else part)
    groups = [g for g in groups if g]
    return Or(tuple(_and(g) for g in groups)) if len(groups) > 1 else _and(groups[0]) if groups else None


def matches(tree, words: Column) -> Column:
    """Whether a token array satisfies the tree."""
    if tree is None:
        return F.lit(False)
    if isinstance(tree, Phrase):
        every = reduce(lambda a, b: a & b, (F.array_contains(words, w) for w in dict.fromkeys(tree.words)))
        if len(tree.words) == 1:
            return every
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - (len(tree.words) - 1), F.lit(1)))
        here = lambda i: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + (k - 1)) == w, F.lit(False)) for k, w in enumerate(tree.words)))
        return every & F.exists(places, here)
    if isinstance(tree, Not):
        return ~matches(tree.part, words)
    parts = [matches(p, words) for p in tree.parts]
    return reduce((lambda a, b: a & b) if isinstance(tree, And) else (lambda a, b: a | b), parts)


def _terms(tree) -> Iterator[str]:
    if isinstance(tree, Phrase):
        yield from tree.words
    elif isinstance(tree, (And, Or)):
        for p in tree.parts:
            yield from _terms(p)
    elif isinstance(tree, Not):
        return


def _holds(tree, at: dict[str, set[int]]) -> bool:
    if isinstance(tree, Phrase):
        return any(all(p + k in at.get(w, ()) for k, w in enumerate(tree.words)) for p in at.get(tree.words[0], ()))
    if isinstance(tree, Not):
        return True  # covers are about the words that must be there
    check = all if isinstance(tree, And) else any
    return check(_holds(p, at) for p in tree.parts)


def cover_density(tree, words: list[str]) -> float:
    """Rank of one text that matches."""
    wanted = set(_terms(tree))
    entries = [(i, w) for i, w in enumerate(words) if w in wanted]
    total, first = 0.0, 0
    while first < len(entries):
        at: dict[str, set[int]] = {}
        last = None
        for k in range(first, len(entries)):
            at.setdefault(entries[k][1], set()).add(entries[k][0])
            if _holds(tree, at):
                last = k
                break
        if last is None:
            break
        at, begin = {}, last
        for k in range(last, first - 1, -1):
            at.setdefault(entries[k][1], set()).add(entries[k][0])
            if _holds(tree, at):
                begin = k
                break
        between = entries[last][0] - entries[begin][0] - (last - begin)
        total += WEIGHT / (1 + between)
        first = begin + 1
    return total


def _positive(tree):
    """The tree without its NOTs, which covers do not ask for."""
    if isinstance(tree, And):
        return _and([_positive(p) for p in tree.parts if not isinstance(p, Not)])
    return Or(tuple(_positive(p) for p in tree.parts)) if isinstance(tree, Or) else tree


def _occurrences(phrase: Phrase, words: Column) -> Column:
    if len(phrase.words) == 1:
        return F.size(F.filter(words, lambda w: w == phrase.words[0]))
    here = lambda w, i: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + k) == x, F.lit(False)) for k, x in enumerate(phrase.words)))
    return F.size(F.filter(words, here))


def _plain_rank(tree, words: Column) -> Column | None:
    """The rank in built-in functions, for phrases, alternatives without a common word, and two words."""
    parts = tree.parts if isinstance(tree, (And, Or)) else (tree,)
    if not all(isinstance(p, Phrase) for p in parts) or len(set(_terms(tree))) != sum(len(set(p.words)) for p in parts):
        return None
    if not isinstance(tree, And):  # every occurrence is a cover of its own, with nothing in between
        return reduce(lambda a, b: a + b, (_occurrences(p, words) for p in parts)) * F.lit(WEIGHT)
    if len(parts) > 2 or any(len(p.words) > 1 for p in parts):
        return None
    # Covers of two words are successive places of different ones.
    one, other = (p.words[0] for p in parts)
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), (w == one).alias("one"), w.isin(one, other).alias("hit"))), lambda x: x["hit"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("i"), F.lit(False).alias("one"))
    step = lambda acc, x: F.struct((acc["sum"] + F.when((acc["i"] >= 0) & (acc["one"] != x["one"]), F.lit(WEIGHT) / (x["i"] - acc["i"])).otherwise(0.0)).alias("sum"), x["i"].alias("i"), x["one"].alias("one"))
    return F.aggregate(places, start, step, lambda acc: acc["sum"])


def rank(tree, words: Column) -> Column:
    """Rank column for rows that match; only queries that mix several words leave the JVM, in Arrow batches."""
    tree = _positive(tree)
    if tree is None:
        return F.lit(0.0)
    plain = _plain_rank(tree, words)
    if plain is not None:
        return plain.cast("float").cast("double")

    @F.pandas_udf("double")
    def density(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: cover_density(tree, list(w)))

    return density(words).cast("float").cast("double")
