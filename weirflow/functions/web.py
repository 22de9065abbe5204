"""URLs, links and checks of identifiers."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def url_host(url: Column) -> Column:
    """Lower-case host without `www.`; null for what is no http(s) URL."""
    host = F.regexp_extract(F.trim(url), r"^[hH][tT][tT][pP][sS]?://([^/?#:@\s]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def url_key(url: Column, kept: str = "gh_jid") -> Column:
    """Key for comparing URLs: host, path without slash at the end, and one query value that names the record."""
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[^:]+://[^/?#]+(/[^?#]*)?", 1), "/+$", "")
    value = F.regexp_extract(url, rf"[?&]{kept}=([^&#]*)", 1)
    return F.when(url_host(url).isNotNull(), F.concat(url_host(url), path, F.when(value != "", F.concat(F.lit(f"?{kept}="), value)).otherwise("")))


def site_of(host: Column) -> Column:
    """The last two labels of a host, three below well-known second-level labels."""
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(r"\.(co|com|org|net|ac|gov)\.[a-z]{2}$"), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def html_links(html: Column) -> Column:
    """Targets of links, images, scripts and style sheets, comments left out."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    return F.regexp_extract_all(bare, F.lit(r"""(?i)<(?:a|img|script|link)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"']+)["']"""), 1)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link seen on a page as an absolute URL without fragment; null for other schemes than http."""

    def one(b: str | None, x: str | None) -> str | None:
        if not x:
            return None
        try:
            whole = urljoin(b or "", x.strip()).split("#")[0]
        except ValueError:
            return None
        return whole if whole.lower().startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def sitemap_entries(xml: Column) -> Column:
    """Array of (loc, lastmod) of a sitemap or sitemap index."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.trim(F.regexp_extract(b, r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("loc"),
            F.nullif(F.regexp_extract(b, r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod"),
        ),
    )


def robots_allowed(rules: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest matching rule decides, allow wins a tie, no match allows.

    ``rules`` is an array of (allow boolean, pattern) with * and an end anchor $ as in robots files.
    """
    quoted = F.transform(
        rules,
        lambda r: F.struct(
            F.length(r["pattern"]).alias("len"), r["allow"].alias("allow"),
            F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(r["pattern"], r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*")).alias("rx"),
        ),
    )
    hits = F.filter(quoted, lambda r: (r["len"] > 0) & F.regexp(path, r["rx"]))
    return F.coalesce(F.array_max(F.transform(hits, lambda r: F.struct(r["len"], r["allow"])))["allow"], F.lit(True))


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a text of digits; false for anything else."""
    return F.coalesce(digits.rlike("^[0-9]+$") & F.call_function("luhn_check", digits), F.lit(False))


def barcode_valid(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{8,14}$"), F.lit(False))


def domain_valid(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"), F.lit(False))


# Addresses of boards: platform, and where the board's name stands, in the host or in the path.
BOARD_HOSTS = (
    ("greenhouse", r"^https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([\w-]+)"), ("lever", r"^https?://jobs(?:\.eu)?\.lever\.co/([\w.-]+)"), ("ashby", r"^https?://jobs\.ashbyhq\.com/([\w.%-]+)"),
    ("workable", r"^https?://apply\.workable\.com/([\w-]+)"), ("recruitee", r"^https?://([\w-]+)\.recruitee\.com"), ("workday", r"^https?://([\w-]+)\.wd\d+\.myworkdayjobs\.com"),
    ("personio", r"^https?://([\w-]+)\.jobs\.personio\.(?:de|com)"), ("teamtailor", r"^https?://([\w-]+)\.teamtailor\.com"), ("jazzhr", r"^https?://([\w-]+)\.applytojob\.com"), ("pinpoint", r"^https?://([\w-]+)\.pinpointhq\.com"),
)
NO_BOARDS = ("www", "api", "app", "careers", "jobs", "help", "support", "embed", "static", "assets", "j")


def board_ref(url: Column) -> Column:
    """(platform, board) of a board's address by the first pattern that fits; null for others and for names no board can have."""
    found = F.lit(None).cast("struct<platform:string,board:string>")
    for platform, pattern in reversed(BOARD_HOSTS):
        board = F.lower(F.regexp_extract(F.lower(F.trim(url)), pattern, 1))
        found = F.when((board != "") & ~board.isin(*NO_BOARDS), F.struct(F.lit(platform).alias("platform"), board.alias("board"))).otherwise(found)
    return found


def posting_ref(url: Column) -> Column:
    """The posting's own id in an address: a query value that names it, else the last part of the path if that holds a number, less the title before or behind it."""
    named = F.nullif(F.regexp_extract(url, r"[?&](?:gh_jid|jobId|job_id|jid)=([\w-]+)", 1), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?:/apply(?:ication)?)?/*$", "")
    uuid = F.nullif(F.regexp_extract(path, r"/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", 1), F.lit(""))
    last = F.regexp_extract(path, r"://[^/]+/(?:[^/]*/)*(?:[^/]*_)?([^/_]*)$", 1)
    leading = F.nullif(F.regexp_extract(last, r"^(\d+)(?:-[A-Za-z][A-Za-z-]*)+$", 1), F.lit(""))  # a number before the title in words
    return F.coalesce(named, uuid, leading, F.when(last.rlike(r"\d"), last))
