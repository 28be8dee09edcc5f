"""Column expressions; all of them stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.schemas import UNKNOWN_HOST

# The characters that count as white space (line breaks, the four information
# separators, space and the breaking Unicode spaces; the no-break spaces do not count).
BLANK_PATTERN = (
    "^[\\t-\\r\\x1c-\\x20\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000]*$"
)


def is_blank(text: Column) -> Column:
    """True for an empty or white-space-only text; null stays null."""
    return text.rlike(BLANK_PATTERN)


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit in which the contract's limits are stated."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check whose condition holds, null when none does.

    A null condition counts as "does not hold", so callers state *faults* positively.
    """
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks])


def micros(at: Column) -> Column:
    """Microseconds since the epoch for both timestamp types (the session runs in UTC)."""
    return F.unix_micros(at.cast("timestamp"))


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Elapsed whole seconds, rounded down."""
    return F.floor((micros(end) - micros(start)) / F.lit(1_000_000)).cast("long")


def token_hash(token: Column) -> Column:
    """SHA-256 of the UTF-8 text as unpadded base64url."""
    standard = F.base64(F.unhex(F.sha2(token, 256)))
    return F.rtrim(F.translate(standard, "+/", "-_"), F.lit("="))


def alert_key(rule: Column | str, host_id: Column) -> Column:
    """``<rule>@<host>``; a missing or blank host is the unknown host."""
    name = F.lit(rule) if isinstance(rule, str) else rule
    host = F.coalesce(blank_to_null(host_id), F.lit(UNKNOWN_HOST))
    return F.concat(name, F.lit("@"), host)


def repeated_error_rule(message: Column) -> Column:
    return F.concat(F.lit("repeated-error-"), F.sha2(message, 256))


# The forms of a repeated error's rule name and of a threshold alert's text.
def percent_message(resource: Column, value: Column, threshold: Column) -> Column:
    return F.format_string("%s is %.1f%% (threshold %.1f%%)", resource, value, threshold)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results later steps share instead of repeating the expressions.

    Filters and projections written on top are otherwise merged with long expressions below them,
    and each mention evaluates such an expression again.  A generator row is not merged.
    """
    one = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(one))
