"""Parsing of time texts: one exact UTC instant in epoch microseconds for each text that denotes one."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

EPOCH = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)
FIRST_US = (datetime(1995, 1, 1) - EPOCH) // MICRO

# Month and weekday names as the sources write them.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10,
    "dezember": 12, "mär": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}

# Offsets in minutes of zone abbreviations where the source's own zone does not know them.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "SGT": 480, "HKT": 480,
}

COMPLETE = re.compile(r"\d{13}|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", re.ASCII)

_NUMBER = re.compile(r"[+-]?\d+([.,]\d+)?([eE][+-]?\d+)?", re.ASCII)
_TIME = r"(?P<h>\d{1,2})[:h.](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_ISO = re.compile(
    r"(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})"
    r"(?:(?:[T\s]\s*)(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?)?(?P<rest>.*)",
    re.ASCII | re.IGNORECASE | re.DOTALL,
)
_BASIC = re.compile(
    r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?:[T\s](?P<h>\d\d):?(?P<mi>\d\d)(?::?(?P<s>\d\d)(?:[.,](?P<f>\d{1,9}))?)?)?"
    r"(?P<rest>.*)",
    re.ASCII | re.IGNORECASE | re.DOTALL,
)
_TAIL = r"(?:[\s,]+(?:um|à|at|a las|las)?\s*(?P<h>\d{1,2})(?:[:.h](?P<mi>\d{2}))(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?)?(?P<rest>.*)"
_SLASH = re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4})" + _TAIL, re.ASCII | re.IGNORECASE | re.DOTALL)
_DOT = re.compile(r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})" + _TAIL, re.ASCII | re.IGNORECASE | re.DOTALL)
_DAY_FIRST = re.compile(
    r"(?:(?P<wd>[^\W\d_]+)\.?,?\s+)?(?P<d>\d{1,2})(?:\.|er|st|nd|rd|th)?[\s-]+(?:de\s+)?(?P<mon>[^\W\d_]+)\.?,?[\s-]+(?:de\s+)?(?P<y>\d{4})" + _TAIL,
    re.IGNORECASE | re.DOTALL,
)
_MONTH_FIRST = re.compile(
    r"(?:(?P<wd>[^\W\d_]+)\.?,\s+)?(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})" + _TAIL,
    re.IGNORECASE | re.DOTALL,
)
_REST = re.compile(
    r"\s*(?P<ap>[ap]\.?m\.?)?\s*(?:uhr|h|heures)?\s*"
    r"(?:(?P<z>z)|(?P<gmt>utc|gmt)?\s*(?P<sign>[+-])(?P<oh>\d{2}):?(?P<om>\d{2})?|(?P<abb>[a-z]{2,5}))?"
    r"\s*(?:\[(?P<zone>[A-Za-z_]+(?:/[A-Za-z_]+)*)\])?\s*",
    re.IGNORECASE | re.ASCII,
)


@lru_cache(maxsize=512)
def zone_of(name: str | None):
    """The zone of that name; UTC for null and empty ones, None for names that no zone has."""
    if not name or name.upper() in ("UTC", "GMT", "Z"):
        return timezone.utc
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _utc_us(wall: datetime, offset: timedelta) -> int:
    return (wall - EPOCH - offset) // MICRO


def _in_zone(wall: datetime, zone) -> int:
    """A repeated wall time is the earlier instant; a skipped one moves forward by the skipped length.

    Both follow from reading the wall time with the offset in force before the change.
    """
    return _utc_us(wall, wall.replace(tzinfo=zone, fold=0).utcoffset())


def _abbreviated(wall: datetime, abbreviation: str, zone) -> int | None:
    """An abbreviation means what the source's zone means by it, else its usual offset."""
    abb = abbreviation.upper()
    if zone is not None and zone is not timezone.utc:
        for fold in (0, 1):
            local = wall.replace(tzinfo=zone, fold=fold)
            if local.tzname() == abb:
                return _utc_us(wall, local.utcoffset())
        for month in (1, 7):
            local = datetime(wall.year, month, 1, tzinfo=zone)
            if local.tzname() == abb:
                return _utc_us(wall, local.utcoffset())
    minutes = ABBREVIATIONS.get(abb)
    return None if minutes is None else _utc_us(wall, timedelta(minutes=minutes))


def _number(text: str) -> int | None:
    """Eight digits are a date; other numbers are epoch seconds, milli- or microseconds by magnitude."""
    try:
        value = Decimal(text.replace(",", "."))
    except InvalidOperation:
        return None
    size = abs(value)
    if size < Decimal(10) ** 11:
        return int(value * 1_000_000)
    if size < Decimal(10) ** 14:
        return int(value * 1000)
    if size < Decimal(10) ** 17:
        return int(value)
    return int(value / 1000) if size < Decimal(10) ** 20 else None


def _calendar(text: str, tz: str | None):
    """(match, year, month, day) of the first form that fits, or None."""
    if m := _ISO.fullmatch(text):
        return m, int(m["y"]), int(m["m"]), int(m["d"])
    if m := _BASIC.fullmatch(text):
        return m, int(m["y"]), int(m["m"]), int(m["d"])
    if m := _SLASH.fullmatch(text):
        a, b = int(m["a"]), int(m["b"])
        month, day = (a, b) if (tz or "").startswith("America/") else (b, a)
        return m, int(m["y"]), month, day
    if m := _DOT.fullmatch(text):
        return m, int(m["y"]), int(m["m"]), int(m["d"])
    for form in (_DAY_FIRST, _MONTH_FIRST):
        if (m := form.fullmatch(text)) and (month := MONTHS.get(m["mon"].lower())):
            return m, int(m["y"]), month, int(m["d"])
    return None


def parse_instant(raw: str | None, tz: str | None) -> int | None:
    """Epoch microseconds of ``raw`` written in zone ``tz`` (null: UTC), or None if it denotes no instant from 1995 on.

    A wall time in a zone of unknown name denotes nothing: no offset is guessed.
    """
    if raw is None:
        return None
    text = raw.strip().strip("\ufeff\u200b").strip()
    if not text:
        return None
    us = None
    if _NUMBER.fullmatch(text) and not re.fullmatch(r"\d{8}", text, re.ASCII):
        us = _number(text)
    elif found := _calendar(text, tz):
        us = _wall(found, tz)
    return us if us is not None and us >= FIRST_US else None


def _wall(found, tz: str | None) -> int | None:
    m, year, month, day = found
    rest = _REST.fullmatch(m["rest"] or "")
    if rest is None:
        return None
    hour, minute, second = (int(m[k] or 0) for k in ("h", "mi", "s"))
    if rest["ap"]:
        if m["h"] is None or not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if rest["ap"][0] in "pP" else 0)
    micro = int(((m["f"] or "") + "000000")[:6])
    next_day = False
    if hour == 24:
        if minute or second or micro:
            return None
        hour, next_day = 0, True
    if minute > 59 or second > 60 or hour > 23:
        return None
    leap = second == 60
    try:
        wall = datetime(year, month, day, hour, minute, 59 if leap else second, micro)
    except ValueError:
        return None
    try:
        wall += timedelta(days=1 if next_day else 0, seconds=1 if leap else 0)
    except OverflowError:  # the year 10000
        return None
    zone = zone_of(tz)
    if rest["z"]:
        return _utc_us(wall, timedelta(0))
    if rest["sign"]:
        minutes = int(rest["oh"]) * 60 + int(rest["om"] or 0)
        if minutes > 18 * 60 or int(rest["om"] or 0) > 59:
            return None
        return _utc_us(wall, timedelta(minutes=minutes if rest["sign"] == "+" else -minutes))
    if rest["abb"]:
        return _abbreviated(wall, rest["abb"], zone)
    if rest["zone"]:
        zone = zone_of(rest["zone"])
    return None if zone is None else _in_zone(wall, zone)
