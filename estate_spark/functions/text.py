"""Column helpers for text, null logic and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def truthy_coalesce(*cols: Column, zero: object = 0) -> Column:
    """First value that is neither null nor ``zero``; the last one is taken as it is."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit(zero)) for c in head], last)


def title_case(c: Column) -> Column:
    """Capital after every non-letter (``initcap`` alone starts words at blanks only)."""
    marked = F.regexp_replace(c, r"([^\p{L} ])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def listing_type(url: Column) -> Column:
    """``sold`` or ``for_sale`` by URL path; null when the path shows neither."""
    return F.when(F.contains(url, F.lit("/salda/")), F.lit("sold")).when(
        F.contains(url, F.lit("/bostad/")), F.lit("for_sale")
    )


def listing_id(url: Column) -> Column:
    """Text after the last dash, trailing slashes ignored."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "-", -1)


def listing_id_strict(url: Column) -> Column:
    """Like :func:`listing_id` without slash handling; null when there is no dash."""
    return F.when(F.contains(url, F.lit("-")), F.substring_index(url, "-", -1))


def fingerprint(property_id: Column | None, url: Column | None) -> Column:
    """SHA-256 hex of the id, or of the URL when the id is blank; null with neither."""
    parts = [blank_to_null(c) for c in (property_id, url) if c is not None]
    return F.sha2(F.coalesce(*parts), 256)


def inner_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, entities for blanks undone.

    What is never closed runs to the end of the page, as in a browser; so no
    character is looked at again for each opening before it. A ``<`` that no
    letter, ``/``, ``!`` or ``?`` follows is text.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(F.regexp_replace(body, r"<(?=[a-zA-Z/!?])[^>]*+(?:>|\z)", " "), "&nbsp;|&#160;", " ")


# The calendar's bounds for epoch seconds: the years 1 to 9999, one day in from either end for any zone.
FIRST_SECOND, LAST_SECOND = -62_135_510_400, 253_402_214_400

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def flexible_date(c: Column, zone: str = "UTC") -> Column:
    """Date from epoch seconds (number or numeric text) or from an ISO date-time.

    Epochs are read in ``zone``; an ISO text keeps its own calendar day. The
    session time zone plays no part. Anything else becomes null.
    """
    seconds = c.try_cast("double")
    usable = F.when((seconds >= FIRST_SECOND) & (seconds <= LAST_SECOND), seconds)
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), usable
    )
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), epoch)
    iso = F.when(F.rlike(c, F.lit(ISO_DATE)), F.substring(c, 1, 10).try_cast("date"))
    return F.when(seconds.isNotNull(), F.to_date(local)).otherwise(iso)
