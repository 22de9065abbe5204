"""Country codes of location texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Country names in English and their own language, with their ISO codes.
COUNTRIES = {
    "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "espana": "ES", "italy": "IT", "italia": "IT", "netherlands": "NL", "nederland": "NL", "belgium": "BE",
    "belgie": "BE", "austria": "AT", "osterreich": "AT", "switzerland": "CH", "schweiz": "CH", "suisse": "CH", "sweden": "SE", "sverige": "SE", "norway": "NO", "norge": "NO",
    "denmark": "DK", "danmark": "DK", "finland": "FI", "suomi": "FI", "poland": "PL", "polska": "PL", "czechia": "CZ", "czech republic": "CZ", "portugal": "PT", "ireland": "IE",
    "united kingdom": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "uk": "GB", "united states": "US", "united states of america": "US", "usa": "US", "canada": "CA",
    "mexico": "MX", "brazil": "BR", "brasil": "BR", "argentina": "AR", "india": "IN", "japan": "JP", "china": "CN", "australia": "AU", "new zealand": "NZ", "greece": "GR",
    "romania": "RO", "hungary": "HU", "turkey": "TR", "israel": "IL", "south africa": "ZA", "singapore": "SG",
}
ISO = frozenset(COUNTRIES.values())


def country_code(text: str | None) -> str | None:
    """The code that a text as a whole is, or names."""
    if not text:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).strip()
    if bare.upper() in ISO or bare.upper() == "UK":
        return "GB" if bare.upper() == "UK" else bare.upper()
    return COUNTRIES.get(re.sub("[^a-z]+", " ", bare.lower()).strip())


def location_codes(locations: Sequence[str] | None) -> list[str]:
    """Sorted codes named in locations: parts between separators, longest runs of up to four words first, no word twice."""
    found: set[str] = set()
    for location in locations or ():
        for part in re.split(r"[,;/|()–-]", location or ""):
            if code := country_code(part):
                found.add(code)
                continue
            words, at = part.split(), 0
            while at < len(words):
                for n in range(min(4, len(words) - at), 0, -1):
                    run = " ".join(words[at : at + n])
                    if (code := country_code(run)) and (len(run) > 2 or run.isupper()):
                        found.add(code)
                        at += n
                        break
                else:
                    at += 1
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def location_codes_udf(locations: pd.Series) -> pd.Series:
    return pd.Series([location_codes(list(x) if x is not None else None) for x in locations], dtype=object)
