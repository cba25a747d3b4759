"""Mail-header column expressions: address parts and RFC-2822 dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions.text import bind

# Fixed patterns: an address is the first ``local@domain`` token of the header; a mail
# date is ``[Www, ]d Mon yyyy HH:MM:SS +hhmm``.
ADDRESS_RE = "([^<\\s@,;\"]+)@([^>\\s,;\"]+)"
# Same matches as ADDRESS_RE, linear time in Java regex: a match can only start where a
# run of local-part characters starts ('@' is not in that class), so the lookbehind and
# the possessive run skip the retries at every position inside a run.
ADDRESS_FAST_RE = "(?<![^<\\s@,;\"])[^<\\s@,;\"]++@[^>\\s,;\"]+"
NAME_RE = "^\\s*\"?([^\"<]*?)\"?\\s*<"
WEEKDAY_RE = "^\\s*[A-Za-z]{3},\\s*"
MAIL_DATE_FORMAT = "d MMM yyyy HH:mm:ss Z"
YEAR_RE = "^\\s*(?:[A-Za-z]{3},\\s*)?\\d{1,2}\\s+[A-Za-z]{3}\\s+(\\d{4})\\s"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def address_match(addr) -> Column:
    """First ``local@domain`` token of a header ('' if none)."""
    return F.regexp_extract(_col(addr), ADDRESS_FAST_RE, 0)


def local_of(match: Column) -> Column:
    return F.when(match != "", F.substring_index(match, "@", 1))


def domain_of(match: Column) -> Column:
    return F.when(match != "", F.lower(F.substring(match, F.instr(match, "@") + 1, 1 << 30)))


def email_of(match: Column) -> Column:
    return F.when(match != "", F.concat(local_of(match), F.lit("@"), domain_of(match)))


def address_local(addr) -> Column:
    return bind(address_match(addr), local_of)


def address_domain(addr) -> Column:
    """Lower-cased domain of the first address in a header, NULL if none parses."""
    return bind(address_match(addr), domain_of)


def address_name(addr) -> Column:
    return _null_if_empty(F.trim(F.regexp_extract(_col(addr), NAME_RE, 1)))


def address_email(addr) -> Column:
    """``local@domain`` rebuilt from the parts (domain lower-cased)."""
    return bind(address_match(addr), email_of)


def parse_mail_date(raw, strict: bool = False) -> Column:
    """RFC-2822 date text to a UTC timestamp; malformed text gives NULL
    (``strict=True`` raises instead)."""
    s = F.trim(F.regexp_replace(_col(raw), WEEKDAY_RE, ""))
    if strict:
        return F.to_timestamp(s, MAIL_DATE_FORMAT)
    return F.try_to_timestamp(s, F.lit(MAIL_DATE_FORMAT))


def year_of(raw, parsed: Column) -> Column:
    """Year on the sender's wall clock read from the text, given the parsed instant
    (NULL when the date does not parse)."""
    year = F.regexp_extract(_col(raw), YEAR_RE, 1)
    return F.when(parsed.isNotNull() & (year != ""), year.cast("int"))


def mail_year(raw) -> Column:
    """Year on the sender's wall clock, read from the text (not from the UTC instant);
    NULL when the date does not parse."""
    return year_of(raw, parse_mail_date(raw))
