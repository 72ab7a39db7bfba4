"""Full-text search: queries, matching, scores, snippets and the top hits.

The score is term frequency: occurrences of positive terms, four for each phrase found, three
quarters for each token with a wanted prefix. It is not BM25.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import tokens

PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
PHRASE_WEIGHT, PREFIX_WEIGHT = 4.0, 0.75


@dataclass(frozen=True)
class Query:
    """A parsed query: what must be there (all, or any), and what must not."""

    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    not_terms: tuple[str, ...] = ()
    not_phrases: tuple[str, ...] = ()
    not_prefixes: tuple[str, ...] = ()
    any_mode: bool = False


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def parse(text: str, mode: str = "", prefix_match: bool = False) -> Query:
    """Words, "phrases", prefixes*, -negatives or NOT, and OR or |, which makes any of them enough.

    Modes: all (and the default) wants all, any wants one, phrase takes the whole as a phrase,
    boolean is the default. prefix_match makes every word a prefix.
    """
    if mode == "phrase":
        return Query(phrases=(" ".join(words_of(text)),))
    found: dict[str, list[str]] = {k: [] for k in ("terms", "phrases", "prefixes", "not_terms", "not_phrases", "not_prefixes")}
    any_mode, negative = mode == "any", False
    for minus, phrase, word in PART.findall(text):
        if not word:
            found["not_phrases" if minus or negative else "phrases"].append(" ".join(words_of(phrase)))
            negative = False
        elif word in ("OR", "|"):
            any_mode = True
        elif word == "NOT":
            negative = True
        elif word != "AND":
            no = "not_" if negative or word.startswith("-") else ""
            star = prefix_match or word.endswith("*")
            found[no + ("prefixes" if star else "terms")].extend(words_of(word))
            negative = False
    return Query(**{k: tuple(v) for k, v in found.items()}, any_mode=any_mode)


@dataclass(frozen=True)
class Prepared:
    """Tokens and normalised text of a row, as Columns."""

    tokens: Column
    joined: Column

    def has_term(self, term: str) -> Column:
        return F.array_contains(self.tokens, term)

    def has_phrase(self, phrase: str) -> Column:
        return F.contains(self.joined, F.lit(f" {phrase} "))

    def has_prefix(self, prefix: str) -> Column:
        return F.exists(self.tokens, lambda t: F.startswith(t, F.lit(prefix)))

    def count(self, test) -> Column:
        return F.size(F.filter(self.tokens, test))


def prepared(tokens_column: Column) -> Prepared:
    return Prepared(tokens_column, F.concat(F.lit(" "), F.array_join(tokens_column, " "), F.lit(" ")))


def matches(q: Query, row: Prepared) -> Column:
    """Whether a row matches; a query of negatives alone matches what they don't exclude."""
    wanted = [*map(row.has_term, q.terms), *map(row.has_phrase, q.phrases), *map(row.has_prefix, q.prefixes)]
    unwanted = [*map(row.has_term, q.not_terms), *map(row.has_phrase, q.not_phrases), *map(row.has_prefix, q.not_prefixes)]
    out = F.lit(True)
    if wanted:
        out = reduce((lambda a, b: a | b) if q.any_mode else (lambda a, b: a & b), wanted)
    for test in unwanted:
        out = out & ~test
    return F.coalesce(out, F.lit(False))


def score(q: Query, row: Prepared) -> Column:
    out = F.lit(0.0)
    for term in q.terms:
        out = out + row.count(lambda t: t == term)
    for phrase in q.phrases:
        out = out + F.when(row.has_phrase(phrase), PHRASE_WEIGHT).otherwise(0.0)
    for prefix in q.prefixes:
        out = out + PREFIX_WEIGHT * row.count(lambda t: F.startswith(t, F.lit(prefix)))
    return out


def search(df: DataFrame, key: str, text: Column, query: Query, where: Column | None = None, limit: int | None = 100) -> DataFrame:
    """key and score of the matching rows, best first, ties by key. Structured predicates go to the scan."""
    rows = df if where is None else df.where(where)
    row = prepared(F.col("tokens"))
    hits = rows.select(F.col(key), tokens(text).alias("tokens")).where(matches(query, row)).select(F.col(key), score(query, row).alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), F.col(key)).limit(limit)
