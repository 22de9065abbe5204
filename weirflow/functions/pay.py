"""Reading of pay texts: amounts, currency and period in several languages and number styles."""

from __future__ import annotations

import re
from typing import NamedTuple


class Pay(NamedTuple):
    low: float | None
    high: float | None
    currency: str | None
    period: str | None


# Signs and names of currencies; a bare $ is USD, ¥ JPY, £ GBP.
CURRENCY_WORDS = {
    "US$": "USD", "A$": "AUD", "AU$": "AUD", "C$": "CAD", "CA$": "CAD", "R$": "BRL", "$": "USD", "€": "EUR", "£": "GBP",
    "¥": "JPY", "₹": "INR", "ZŁ": "PLN", "SFR.": "CHF", "SFR": "CHF", "FR.": "CHF", "KR": "SEK", "RS.": "INR", "RS": "INR",
    "EURO": "EUR", "EUROS": "EUR", "US DOLLAR": "USD", "US DOLLARS": "USD", "DOLLAR": "USD", "DOLLARS": "USD",
    "POUND STERLING": "GBP", "POUND": "GBP", "POUNDS": "GBP", "YEN": "JPY", "RUPEE": "INR", "RUPEES": "INR",
    "SWISS FRANC": "CHF", "FRANKEN": "CHF", "KRONOR": "SEK", "GBX": "GBP", "円": "JPY",
}

ISO_CODES = ("AUD", "BRL", "CAD", "CHF", "EUR", "GBP", "INR", "JPY", "PLN", "SEK", "USD")

# How sources name the pay periods; matched as whole words, the longest first.
PERIOD_WORDS = {
    "hour": ["per-hour-wage", "per-hour", "hourly", "hour", "hours", "hr", "h", "stunde", "stündlich", "std", "heure", "l'heure", "hora"],
    "day": ["per-day-wage", "per-day", "day rate", "daily", "day", "tag", "täglich", "jour", "journalier", "día", "tagessatz"],
    "week": ["per-week-salary", "per-week", "weekly", "week", "wk", "woche", "wöchentlich", "semaine", "hebdomadaire", "semana"],
    "fortnight": ["bi-week-salary", "biweekly", "bi-weekly", "fortnightly", "fortnight", "every two weeks", "alle zwei wochen", "toutes les deux semaines"],
    "half_month": ["semi-month-salary", "semi-monthly", "semimonthly", "twice a month", "zweimal im monat", "deux fois par mois", "half_month"],
    "month": ["per-month-salary", "per-month", "monthly", "month", "mo", "monat", "monatlich", "mois", "mensuel", "mes"],
    "quarter": ["per-quarter-salary", "per-quarter", "quarterly", "quarter", "quartal", "vierteljährlich", "trimestre", "trimestriel"],
    "year": ["per-year-salary", "per-year", "annually", "annual", "yearly", "year", "yr", "annum", "p.a.", "p.a", "pa", "jahr", "jährlich", "an", "annuel", "año", "lpa"],
}

_BY_WORD = {word: period for period, words in PERIOD_WORDS.items() for word in words}
_SPACES = "   "
_PERIOD = re.compile(
    r"(?<![^\W\d_])(?:" + "|".join(re.escape(w) for w in sorted(_BY_WORD, key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE
)
_MONEY_SIGN = r"US\$|AU?\$|CA?\$|R\$|\$|€|£|¥|₹|zł|SFr\.?|Rs\.?|kr\b|円"
_CODE = r"\b(?:" + "|".join(ISO_CODES) + r")\b"
_SIGN = re.compile(rf"{_MONEY_SIGN}|{_CODE}|(?<=k)(?:EUR|USD|€)|\b(?:euros?|us dollars?|pounds?(?: sterling)?|yen|rupees?)\b", re.IGNORECASE)
_DIGITS = rf"\d{{1,3}}(?:[ .,'’{_SPACES}]\d{{3}})+(?:[.,]\d{{1,2}})?(?!\d)|\d+(?:[.,]\d{{1,2}})?(?!\d)|\d+(?:[.,]\d+)?"
_SCALE = r"k\b|K\b|thousand\b|Tsd\.?|mille\b|lakhs?\b|lacs?\b|LPA\b|crores?\b|mn\b|m\b|M\b|万"
_AMOUNT = re.compile(rf"(?P<n>{_DIGITS})\s?(?P<s>{_SCALE})?(?P<pct>\s?%)?")
_LOWER_WORDS = ("a partir de", "ab", "at least", "au moins", "desde", "dès", "from", "min", "min.", "mindestens", "minimum", "no less than", "starting", "starting at", "starting from", "à partir de")
_UPPER_WORDS = ("at most", "au plus", "bis", "bis zu", "hasta", "höchstens", "jusqu'à", "jusqu’à", "max", "max.", "maximum", "no more than", "up to")


def _before_amount(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words right before an amount."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(w) for w in sorted(words, key=len, reverse=True))})\s*$", re.IGNORECASE)


_LOWER, _UPPER = _before_amount(_LOWER_WORDS), _before_amount(_UPPER_WORDS)
_LUMP = re.compile(r"\b(?:one[- ]time|einmalig|unique|once|sign(?:ing|-on)?[ -]bonus|lump sum|per project)\b", re.IGNORECASE)
_BONUS_BEFORE = re.compile(r"(?:bonus(?:es)?|prämie|prime)\b[^;,.]*$", re.IGNORECASE)
_BONUS_AFTER = re.compile(r"^[^;,.\d]{0,12}\b(?:signing |sign-on |retention |annual )?(?:bonus|prämie)\b", re.IGNORECASE)
_RANGE = re.compile(rf"^[\s{_SPACES}]*(?:{_MONEY_SIGN}|{_CODE})?\s*(?:-|–|—|to|bis|à|a|and|und|et)\s*(?:{_MONEY_SIGN}|{_CODE})?[\s{_SPACES}]*$", re.IGNORECASE)

_SCALES = {"k": 1e3, "thousand": 1e3, "tsd": 1e3, "tsd.": 1e3, "mille": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "crore": 1e7, "crores": 1e7, "mn": 1e6, "m": 1e6, "万": 1e4}


def number(text: str) -> float:
    """The value of digits in any style: a last separator followed by three digits groups, else it is the decimal mark."""
    text = re.sub(rf"[ '’{_SPACES}]", "", text)
    marks = [c for c in text if c in ".,"]
    if not marks:
        return float(text)
    last = max(text.rfind("."), text.rfind(","))
    after = len(text) - last - 1
    if len(set(marks)) == 2:
        other = "," if text[last] == "." else "."
        return float(text.replace(other, "").replace(text[last], "."))
    if len(marks) > 1 or after == 3:
        return float(text.replace(marks[0], ""))
    return float(text.replace(marks[0], "."))


def currency_of(text: str | None) -> tuple[str | None, float]:
    """(code, scale) of a currency text; its scale multiplies the amounts. (None, 1) if it names no currency."""
    if text is None:
        return None, 1.0
    t = " ".join(text.split()).strip()
    up, scale = t.upper(), 1.0
    if up in ("GBX", "GBP PENCE", "PENCE"):
        return "GBP", 0.01
    if re.search(r"\bCENTS?\b|\bPENCE\b|\bMINOR\b", up):
        scale, up = 0.01, re.sub(r"\b(?:CENTS?|PENCE|MINOR(?: UNITS)?)\b", "", up)
    elif re.search(r"\bLAKHS?\b", up):
        scale, up = 1e5, re.sub(r"\bLAKHS?\b", "", up)
    elif re.search(r"\bCRORES?\b", up):
        scale, up = 1e7, re.sub(r"\bCRORES?\b", "", up)
    elif "万円" in up:
        return "JPY", 1e4
    elif re.search(r"\(?\bIN 1[.,' ]?000\)?|\bIN THOUSANDS?\b|\bTHOUSANDS?\b|\bTSD\.?|'000", up):
        scale, up = 1e3, re.sub(r"\(?\bIN 1[.,' ]?000\)?|\(?\bIN THOUSANDS?\b\)?|\bTHOUSANDS?\b|\bTSD\.?|'000", "", up)
    elif re.search(r"\bMILLIONS?\b|\bMIO\.?", up):
        scale, up = 1e6, re.sub(r"\bMILLIONS?\b|\bMIO\.?", "", up)
    up = " ".join(up.replace("(", " ").replace(")", " ").split())
    if m := re.fullmatch(r"[TK]\s?(EUR|USD|GBP|CHF|PLN|SEK|CAD|AUD|BRL|INR|JPY|€|\$|£)", up):
        scale, up = 1e3, m[1]
    if up in ISO_CODES:
        return up, scale
    code = CURRENCY_WORDS.get(up)
    return code, scale


def period_of(text: str | None) -> str | None:
    """The pay period that a text names, or None."""
    if not text:
        return None
    t = text.replace("’", "'").strip().lower()
    if t in _BY_WORD:
        return _BY_WORD[t]
    if _LUMP.search(t):
        return None
    hits = _PERIOD.findall(t)
    return _BY_WORD[max(hits, key=len).lower()] if hits else None


def read_pay(text: str | None) -> Pay:
    """Amounts, currency and period stated in a pay text; amounts of bonuses, one-time sums and percentages don't count."""
    if not text or not text.strip():
        return Pay(None, None, None, None)
    t = text.replace("’", "'")
    hits = []
    for m in _AMOUNT.finditer(t):
        before, after = t[: m.start()], t[m.end() :]
        if m["pct"] or _BONUS_BEFORE.search(before) or _BONUS_AFTER.match(after):
            continue
        if before and (before[-1].isalpha() and not _SIGN.search(before[-4:])):
            continue
        hits.append((m, number(m["n"]), _SCALES.get((m["s"] or "").lower(), 1.0)))
    sign = _SIGN.search(t)
    code = None
    if sign:
        code = currency_of(sign[0])[0]
    if code is None and re.search(r"\bLPA\b|\blakhs?\b|\bcrores?\b", t, re.IGNORECASE):
        code = "INR"  # counted in lakhs and crores, pay is in rupees
    # Only amounts joined by a range mark, or the first one, make up the pay.
    if not hits:
        return Pay(None, None, code, None)
    low = high = None
    first = hits[0]
    before = t[: first[0].start()]
    before = re.sub(rf"(?:{_MONEY_SIGN}|{_CODE})\s*$", "", before, flags=re.IGNORECASE).rstrip()
    end = first[0].end()
    if len(hits) > 1 and _RANGE.match(t[end : hits[1][0].start()]):
        second = hits[1]
        shared = first[2] == 1.0 and first[1] <= second[1]  # "40-50k": the scale holds for both
        low, high = first[1] * (second[2] if shared else first[2]), second[1] * second[2]
        end = hits[1][0].end()
    elif _UPPER.search(before):
        high = first[1] * first[2]
    elif _LOWER.search(before):
        low = first[1] * first[2]
    else:
        low = high = first[1] * first[2]
    lump = _LUMP.search(t)
    tail = t[end:]
    if re.search(r"\bLPA\b", t):
        period = "year"
    else:
        tail_head = re.split(r"[,;+(]", tail, maxsplit=1)[0]
        period = period_of(tail_head) or period_of(re.sub(r"\d[\d.,' ]*", " ", t[: first[0].start()]))
    if lump and not period:
        return Pay(None, None, code, None)
    return Pay(low, high, code, period)
