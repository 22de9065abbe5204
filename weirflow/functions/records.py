"""Functions over single records: policies, ratings, versions, variants of names and multimaps of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import fold_accents


def spf_policy(record: Column) -> Column:
    """(valid, lookups, last) of a sender policy: mechanisms that cost a lookup, and what happens to all other senders."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(record, F.lit("")))), r"\s+"), lambda w: w != "")
    costly = F.filter(words, lambda w: w.rlike(r"^[+?~-]?(?:include:|a$|a:|mx$|mx:|ptr|exists:)|^redirect="))
    last = F.get(F.filter(words, lambda w: w.rlike("^[+?~-]?all$")), 0)
    return F.struct(F.coalesce(F.get(words, 0) == "v=spf1", F.lit(False)).alias("valid"), F.size(costly).alias("lookups"), last.alias("last"))


def tag_list(record: Column) -> Column:
    """Map of `tag=value` pairs parted by semicolons, as policy records hold them; the last of equal tags counts."""
    return F.str_to_map(F.regexp_replace(F.coalesce(record, F.lit("")), r"\s*(;|=)\s*", "$1"), F.lit(";"), F.lit("="))


def graded(points: Column, bounds: Sequence[tuple[int, str]], otherwise: str) -> Column:
    """The label of the first (least points, label) reached, greatest bound first."""
    found = F.lit(otherwise)
    for least, label in sorted(bounds):
        found = F.when(points >= least, label).otherwise(found)
    return found


def rated(value: Column, good: float, poor: float) -> Column:
    """good up to the first bound, poor beyond the second, else needs work; null for null."""
    return F.when(value <= good, "good").when(value > poor, "poor").when(value.isNotNull(), "needs work")


def version_key(version: Column) -> Column:
    """A dotted version as an array of numbers, which orders as versions do."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def best_version(versions: Column) -> Column:
    """The newest of an array of versions; of equal ones the more exact."""
    return F.array_max(F.transform(versions, lambda v: F.struct(version_key(v).alias("key"), v.alias("version"))))["version"]


# Letters of other scripts that look like Latin ones, with these.
LOOKALIKES = ("АВЕКМНОРСТХаеорсухіјѕ", "ABEKMHOPCTXaeopcyxijs")


def repaired_name(name: Column) -> Column:
    """A name in which Latin letters prevail, with look-alikes of other scripts as Latin ones; other names stay."""
    latin = F.length(F.regexp_replace(name, r"[^\p{IsLatin}]", ""))
    others = F.length(F.regexp_replace(name, r"[^\p{L}]", "")) - latin
    return F.when(latin > others, F.translate(name, *LOOKALIKES)).otherwise(name)


def name_variants(name: Column) -> Column:
    """The name without what stands in parentheses, and each of these parts by itself; empty ones left out, null as none."""
    held = F.coalesce(name, F.lit(""))
    inner = F.regexp_extract_all(held, F.lit(r"\(([^()]*)\)"), 1)
    bare = F.regexp_replace(F.regexp_replace(held, r"\([^()]*\)", " "), r"\s+", " ")
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(bare), inner), lambda x: F.trim(x)), lambda x: x != ""))


def page_title(html: Column) -> Column:
    """A page's title: the one it gives for sharing, else its title element."""
    shared = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']og:title["'])[^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    own = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(tidy(shared), tidy(own))


def terms_within(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in the lower-case text, in their own order; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def multimap(lines: Column, most: int = 1000) -> Column:
    """Map of lower-case field names to arrays of their values in order, from lines `name: value`; values are cut at ``most`` characters, a bound of the format."""
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("n"), F.substring(F.trim(F.substr(x, F.instr(x, ":") + 1)), 1, most).alias("v"), F.instr(x, ":").alias("at"))), lambda p: p["at"] > 1)
    names = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["v"])))


def plain_codes(codes: Column, digits: int = 8) -> Column:
    """Codes as their first ``digits`` digits, each once, in first-seen order; those with fewer than two digits are none."""
    bare = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), 1, digits))
    return F.array_distinct(F.filter(bare, lambda c: F.length(c) >= 2))


def near_name(asked: str, name_tokens: Column) -> Column:
    """Whether each word of ``asked`` begins a word of the name or is one edit away from it (words of five letters and more)."""
    wanted = fold_accents(F.lit(asked.lower()))
    words = F.filter(F.split(wanted, "[^a-z0-9]+"), lambda w: w != "")
    one = lambda w: F.exists(name_tokens, lambda t: t.startswith(w) | ((F.length(w) >= 5) & (F.levenshtein(t, w, 1) != -1)))
    return (F.size(words) > 0) & F.forall(words, one)


def region_codes(asked: str, regions: Mapping[str, Sequence[str]]) -> list[str]:
    """Country codes of a region by name, of a code itself, or of an offset such as UTC+1 among the regions' names."""
    low = asked.strip().lower()
    if low in regions:
        return sorted(regions[low])
    known = {c for codes in regions.values() for c in codes}
    return [asked.strip().upper()] if asked.strip().upper() in known else []


def share_of(value: float) -> float:
    """A threshold given as a share or in hundredths, as a share between 0 and 1."""
    return min(1.0, max(0.0, value / 100 if value > 1 else value))
