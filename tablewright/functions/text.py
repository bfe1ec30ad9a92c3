"""Text functions: each takes and returns a Column, stays in the JVM and never touches nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column-name parts that mark a column as sensitive.
SENSITIVE_NAME_HINTS = (
    "email", "e-mail", "phone", "mobile", "ssn", "social", "card", "credit", "debit", "account",
    "iban", "routing", "secret", "token", "password", "passwd", "pin",
)
SAMPLE_TEXT_LIMIT = 64


# Everything that counts as white space at the ends of a text.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Strip every kind of white space (plain ``trim`` only knows blanks; a pattern would cost several times more)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def change_case(c: Column, case: str) -> Column:
    match case:
        case "lower":
            return F.lower(c)
        case "upper":
            return F.upper(c)
        case "title":
            return F.initcap(c)
        case "capitalize":
            return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))
    raise ValueError(f"unknown case {case!r}")


def replace_values(c: Column, mapping: dict) -> Column:
    """Whole values only; anything not named stays."""
    if not mapping:
        return c
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def strip_currency(c: Column) -> Column:
    return F.regexp_replace(c, "[$£€¥]", "")


def remove_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def word_form(c: Column) -> Column:
    """Lower case words parted by one blank: ``Pay-Pal `` becomes ``pay pal``."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_form(c: Column) -> Column:
    """Only letters and digits: ``Pay-Pal `` becomes ``paypal``."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def name_tokens(c: Column) -> Column:
    """Lower-case tokens of an identifier, split at underscores, blanks and case changes."""
    parts = F.split(c, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\s]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.lower(t))


def looks_sensitive(name: str) -> bool:
    flat = "".join(ch if ch.isalnum() else "_" for ch in name.strip().lower())
    return any(h in flat for h in SENSITIVE_NAME_HINTS)


def mask_text(c: Column) -> Column:
    """E-mail keeps its first letter and domain, long numbers their last four digits."""
    digits = F.regexp_replace(c, r"[^0-9]+", "")
    at = F.instr(c, "@")
    return (
        F.when(at == 1, F.lit("<redacted>"))
        .when(at > 1, F.concat(F.substring(c, 1, 1), F.lit("***"), c.substr(at, F.length(c))))
        .when(F.length(digits) >= 6, F.concat(F.lit("****"), F.right(digits, F.lit(4))))
        .when(F.length(c) <= 12, F.lit("<redacted>"))
        .otherwise(F.concat(F.substring(c, 1, 2), F.lit("***"), F.right(c, F.lit(2))))
    )


def sample_text(c: Column, sensitive: bool) -> Column:
    """A value as shown in a profile: masked where needed, no control characters, 64 characters."""
    shown = mask_text(c) if sensitive else c
    return F.substring(F.regexp_replace(shown, "[\\x00-\\x08\\x0B-\\x1F]", ""), 1, SAMPLE_TEXT_LIMIT)


def display_id(c: Column, prefix: str = "FF", width: int = 5) -> Column:
    """``FF-00042``; longer numbers are never cut."""
    text = c.cast("string")
    return F.concat(F.lit(prefix + "-"), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def short_title(c: Column, width: int = 72) -> Column:
    return F.concat(F.substring(c, 1, width), F.when(F.length(c) > width, "...").otherwise(""))


def first_text(*cols: Column) -> Column:
    """First non-blank text among the given columns, else ``-``."""
    usable = F.filter(F.array(*cols), lambda x: x.isNotNull() & (strip_ws(x) != ""))
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit("-"))


def summary_line(c: Column) -> Column:
    """White space collapsed, one closing full stop cut."""
    return F.regexp_replace(strip_ws(F.regexp_replace(c, r"\s+", " ")), r"\.$", "")


def clock_text(ts_utc: Column, zone: str) -> Column:
    """UTC wall clock shown as HH:mm in a display time zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc.cast("timestamp_ntz")), "HH:mm")


def age_label(seconds: Column) -> Column:
    """Minutes under an hour, hours under a day, else days; at least one minute."""
    minutes = F.greatest(F.lit(1.0), F.floor(seconds / 60 + 0.5))
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    amount = F.when(minutes < 60, minutes).when(hours < 24, hours).otherwise(days).cast("bigint")
    unit = F.when(minutes < 60, "min").when(hours < 24, "hr").otherwise("day")
    return F.format_string("Last run %d %s ago", amount, unit)


def literal_text(c: Column, numeric: bool) -> Column:
    """Text of a literal for a target type: whole numbers lose their ``.0``, other text is stripped."""
    plain = strip_ws(c)
    if not numeric:
        return plain
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    whole = number.isNotNull() & (number == F.floor(number))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(plain)
