"""Declarative membership: rules, lenses, facets and scored screening."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule. With ``domain`` given nothing else is evaluated; else the gate and any positive clause."""

    name: str
    domain: str | None = None
    gate: Sequence[str] = ()
    ids: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    terms: Sequence[str] = ()
    patterns: Sequence[str] = ()
    exclude: Sequence[str] = field(default_factory=tuple)

    def matches(self, id_: Column, domain: Column, text: Column) -> Column:
        """Predicate over an item; a rule without a positive clause selects nothing; exclusion comes last."""
        if self.domain is not None:
            hit = domain == self.domain
        else:
            clauses = [id_.isin(list(self.ids))] if self.ids else []
            clauses += [id_.startswith(f"{p}_") for p in self.prefixes]
            clauses += [F.lower(text).contains(t) for t in self.terms] + [F.lower(text).rlike(p) for p in self.patterns]
            hit = reduce(Column.__or__, clauses, F.lit(False))
            if self.gate:
                hit = domain.isin(list(self.gate)) & hit
        hit = F.coalesce(hit, F.lit(False))
        return hit & ~F.coalesce(id_.isin(list(self.exclude)), F.lit(False)) if self.exclude else hit


def members(df: DataFrame, rules: Sequence[Rule], id_: str, domain: str, text: Column) -> DataFrame:
    """(``rule``, id) of every item that a rule selects, all rules in one pass over the items."""
    hits = F.array(*[F.when(r.matches(F.col(id_), F.col(domain), text), F.lit(r.name)) for r in rules])
    return df.select(F.explode(F.array_compact(hits)).alias("rule"), id_)


def within_lenses(items: DataFrame, id_: str, lenses: DataFrame, active: Sequence[str]) -> DataFrame:
    """Items in every active lens; an empty name is ignored, an unknown lens has no members."""
    for lens in active:
        if lens:
            items = items.join(lenses.where(F.col("rule") == lens).select(id_), id_, "left_semi")
    return items


def faceted(df: DataFrame, facets: dict[str, str | None], fields: Sequence[str], text: str | None) -> DataFrame:
    """Rows that meet all given facets and hold the text, case apart, in the joined fields."""
    for name, value in facets.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if text:
        df = df.where(F.lower(F.concat_ws(" ", *fields)).contains(text.lower()))
    return df


def screened(df: DataFrame, text: Column, weighted: dict[str, tuple[str, int]], base: Column) -> DataFrame:
    """Rows that any pattern matches, with ``score`` (weights of those that do, plus a base) and their names."""
    hits = {n: F.coalesce(F.lower(text).rlike(p), F.lit(False)) for n, (p, _) in weighted.items()}
    score = reduce(Column.__add__, [F.when(hits[n], w).otherwise(0) for n, (_, w) in weighted.items()]) + base
    names = F.concat_ws("; ", *[F.when(h, F.lit(n)) for n, h in hits.items()])
    return df.withColumns({"score": score, "reasons": names}).where(reduce(Column.__or__, hits.values()))


def within_or_unknown(x: Column, most: float) -> Column:
    """True where a number is at most a bound or not known."""
    return x.isNull() | (x <= most)
