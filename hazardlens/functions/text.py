"""Native text functions: all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, and secrets as they appear in logs with what takes their place.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRETS = (
    (r'(?i)("?(?:password|token|secret|jwt|groq_api_key|api_key)"?\s*[:=]\s*)"[^"]+"', '$1"[REDACTED]"'),
    (r'(?i)("?(?:password|token|secret|jwt|groq_api_key|api_key)"?\s*[:=]\s*)[^\s,}\']+', "$1[REDACTED]"),
    (r"(?i)Bearer\s+[A-Za-z0-9\-\._~\+\/]+=*", "Bearer [REDACTED]"),
    (r"(?i)postgresql\+?[^:]*://[^:]+:[^@]+@", "postgresql://[USER]:[REDACTED]@"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[REDACTED_CARD]"),
)
_YEAR = r"[+-]?\d{4,}"
#: Formats of free-form dates in order, by the shape of the texts that they can read (no text has two shapes); the month comes
#: before the day where both readings are possible. A format that doesn't fit throws an exception, which costs more than all shapes.
DAY_FORMATS = {
    rf"^{_YEAR}-\d\d-\d\d$": ("yyyy-MM-dd",), rf"^{_YEAR}/\d\d/\d\d$": ("yyyy/MM/dd",), r"^[+-]?\d{8,}$": ("yyyyMMdd",),
    rf"^\d+/\d+/{_YEAR}$": ("M/d/yyyy", "d/M/yyyy"), rf"^\d+-\d+-{_YEAR}$": ("M-d-yyyy", "d-M-yyyy"), rf"^\d+\.\d+\.{_YEAR}$": ("M.d.yyyy", "d.M.yyyy"),
}
#: The same with a month's name; a short one has three letters.
NAMED_FORMATS = {
    rf"^[^\d ]{{3}} \d+, {_YEAR}$": ("MMM d, yyyy",), rf"^[^\d ]{{4,}} \d+, {_YEAR}$": ("MMMM d, yyyy",), rf"^[^\d ]{{3}} \d+ {_YEAR}$": ("MMM d yyyy",),
    rf"^[^\d ]{{4,}} \d+ {_YEAR}$": ("MMMM d yyyy",), rf"^\d+ [^\d ]{{3}} {_YEAR}$": ("d MMM yyyy",), rf"^\d+ [^\d ]{{4,}} {_YEAR}$": ("d MMMM yyyy",),
}


def normalized(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _read(c: Column, formats: dict[str, tuple[str, ...]]) -> Column:
    """The day that the first fitting format of a text's shape reads."""
    out = F
    for shape, some in formats.items():
        out = out.when(c.rlike(shape), F.coalesce(*[F.try_to_date(c, f) for f in some]))
    return out


def report_date(c: Column, as_of: str) -> Column:
    """ISO day of a free-form date, with or without a time; the given day if there is none."""
    whole = F.trim(c)
    day = F.regexp_extract(whole, r"^(\S+?)(?:[T ]\d{1,2}:.*)?$", 1)
    return F.coalesce(F.coalesce(_read(day, DAY_FORMATS), _read(whole, NAMED_FORMATS)).cast("string"), F.lit(as_of))


def content_hash(description: Column, date: Column, site: Column) -> Column:
    """Digest of description, date and site in lower case with single spaces; null is empty, no site is Site Alpha."""
    place = F.coalesce(F.nullif(site, F.lit("")), F.lit("site alpha"))
    return F.md5(F.concat(F.lower(normalized(description)), F.lit("|"), F.lower(normalized(date)), F.lit("|"), F.lower(normalized(place))))


def legacy_hash(description: Column, date: Column, location: Column) -> Column:
    """The older digest, in which a missing location is empty."""
    return F.md5(F.concat(F.lower(normalized(description)), F.lit("|"), F.lower(normalized(date)), F.lit("|"), F.lower(normalized(location))))


def masked_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[EMAIL]")


def scrubbed(c: Column) -> Column:
    """Secrets that logs must not show, one pattern after another."""
    for pattern, put in SECRETS:
        c = F.regexp_replace(c, pattern, put)
    return c


def sif_label(c: Column) -> Column:
    """YES, NO or UNKNOWN from the labels that uploads use."""
    v = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("YES", "Y", "1", "TRUE"), "YES").when(v.isin("NO", "N", "0", "FALSE"), "NO").otherwise("UNKNOWN")


def script_language(c: Column) -> Column:
    """kn or hi by the share of their scripts' letters (over a tenth), unknown if blank, else en."""
    size = F.length(F.trim(c))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    kn, hi = share("[ಀ-೿]"), share("[ऀ-ॿ]")
    return F.when(F.coalesce(size, F.lit(0)) == 0, "unknown").when(kn > 0.1, "kn").when(hi > 0.1, "hi").otherwise("en")
