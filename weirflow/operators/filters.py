"""Composable predicates of searches. Each returns a column that is never null, so that it can be negated."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.text import company_key, fold_accents, match_key


def holds(condition: Column) -> Column:
    """The condition with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def one_of(value: Column, wanted: Iterable[str]) -> Column:
    return holds(value.isin(list(wanted)))


def is_remote(workplace: Column, remote: Column) -> Column:
    """Remote by either field; the negation takes rows in which neither says so."""
    return holds(workplace == "remote") | holds(remote)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Any term as part of the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(low.contains(t.lower()) for t in terms)


def whole_words_any(text: Column, terms: Iterable[str]) -> Column:
    """Any term as whole words of the text's match key."""
    padded = F.concat(F.lit(" "), match_key(text), F.lit(" "))
    keys = [k for t in terms if (k := _key(t))]
    return any_of(padded.contains(f" {k} ") for k in keys)


def _key(term: str) -> str:
    import re
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", bare.lower().replace("&", " and ")).strip()


def in_places(codes: Column, locations: Column, country_codes: Iterable[str] = (), places: Iterable[str] = ()) -> Column:
    """A country code of the row, or a place as whole words of its locations."""
    by_code = holds(F.arrays_overlap(codes, F.array(*map(F.lit, country_codes)))) if (country_codes := list(country_codes)) else F.lit(False)
    return by_code | whole_words_any(F.array_join(locations, " | "), places)


def company_is(name: Column, board: Column, term: str) -> Column:
    """The board's own name, the company's key, or a key of four characters and more as whole words of it."""
    import re

    from weirflow.functions.text import LEGAL_FORMS

    key = re.sub(" +", " ", re.sub(rf"\b({LEGAL_FORMS})\b", " ", _key(term))).strip()
    own = holds(F.lower(board) == term.lower().strip())
    if not key:
        return own
    held = company_key(name)
    within = F.concat(F.lit(" "), held, F.lit(" ")).contains(f" {key} ") if len(key) >= 4 else F.lit(False)
    return own | (held == key) | within


def code_prefix_any(codes: Column, prefixes: Iterable[str]) -> Column:
    """Any code of the array begins with any of the prefixes."""
    return holds(F.exists(codes, lambda c: any_of(c.startswith(p) for p in prefixes)))


def folded_contains(text: Column, term: str) -> Column:
    """A term as part of the text, without regard to case and accents."""
    bare = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    return bare.contains(F.lower(fold_accents(F.lit(term))))


def amount_between(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Within the bounds; a null amount fails any bound."""
    parts = ([value >= least] if least is not None else []) + ([value <= most] if most is not None else [])
    return all_of(map(holds, parts))


def without_matches(df: DataFrame, terms: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``df`` that match no row of the small table ``terms`` (its size is checked)."""
    if terms.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 exclusion terms")
    return df.join(F.broadcast(terms), condition, "left_anti")
