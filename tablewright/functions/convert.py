"""Conversions that give null instead of failing, and the parse tests behind type detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import remove_commas, strip_ws

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Currency signs and ISO codes taken as money.
CURRENCY_SIGNS = "[$€£¥]"
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR")
_UNIT = f"({CURRENCY_SIGNS}|{'|'.join(CURRENCY_CODES)})?"
CURRENCY_PATTERN = rf"(?i)^\s*{_UNIT}\s*[-+]?\d{{1,3}}([,\s]?\d{{3}})*(\.\d+)?\s*{_UNIT}\s*$"
CURRENCY_STRIP = rf"(?i){CURRENCY_SIGNS}|\b({'|'.join(CURRENCY_CODES)})\b"

# The date layouts understood. ISO text and re-ordered numeric dates are read by a plain cast,
# which is much cheaper than a layout; only named months need one.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?)?$"
NUMERIC_DATE = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"
SLASHED_DATE = r"^\d{4}/\d{2}/\d{2}$"
NAMED_MONTHS = ((r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"))

# Strftime directives and the matching Java pattern letters.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy",
    "%b": "MMM", "%B": "MMMM", "%I": "hh", "%p": "a", "%j": "DDD",
}


def to_number(c: Column) -> Column:
    """Plain or exponent notation only; ``1d``, ``inf`` and ``nan`` are not numbers."""
    plain = strip_ws(c)
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def is_number(c: Column) -> Column:
    """Whether ``to_number`` gives a value, without reading it."""
    return strip_ws(c).rlike(NUMBER_PATTERN)


def currency_number(c: Column, bracket_negative: bool = False) -> Column:
    """Keep digits, point and minus, then read as a number; optionally ``(5)`` is minus five."""
    kept = F.regexp_replace(c, r"[^0-9.\-]", "")
    number = F.when(kept.rlike(NUMBER_PATTERN), kept.try_cast("double"))
    return F.when(strip_ws(c).rlike(r"^\(.*\)$"), -number).otherwise(number) if bracket_negative else number


def plain_number(c: Column) -> Column:
    return to_number(remove_commas(c))


def money_number(c: Column) -> Column:
    """Signs and ISO codes out, commas out, then a number."""
    return to_number(remove_commas(F.regexp_replace(c, CURRENCY_STRIP, "")))


def looks_like_money(c: Column) -> Column:
    return c.rlike(CURRENCY_PATTERN)


def to_timestamp(c: Column, dayfirst: bool = False) -> Column:
    """Date text to a timestamp. Of two readings of day and month the preferred one wins, else the other."""
    plain = strip_ws(c)
    orders = ("$4-$3-$1", "$4-$1-$3") if dayfirst else ("$4-$1-$3", "$4-$3-$1")
    numeric = F.coalesce(*[F.regexp_replace(plain, NUMERIC_DATE, o).try_cast("timestamp_ntz") for o in orders])
    named = F.coalesce(*[F.when(plain.rlike(guard), F.try_to_timestamp(plain, F.lit(layout))) for guard, layout in NAMED_MONTHS])
    return (
        F.when(plain.rlike(ISO_DATE), plain.try_cast("timestamp_ntz"))
        .when(~F.length(plain).between(8, 12), None)
        .when(plain.rlike(NUMERIC_DATE), numeric)
        .when(plain.rlike(SLASHED_DATE), F.translate(plain, "/", "-").try_cast("timestamp_ntz"))
        .otherwise(named.cast("timestamp_ntz"))
    )


def java_pattern(strftime: str) -> str:
    out = strftime
    for directive, letters in STRFTIME_TO_JAVA.items():
        out = out.replace(directive, letters)
    if "%" in out:
        raise ValueError(f"unsupported date directive in {strftime!r}")
    return out


def normalize_date(c: Column, target_format: str = "%Y-%m-%d", dayfirst: bool = False, errors: str = "coerce") -> Column:
    """Date text in one format; ``errors='raise'`` fails on text that is no date."""
    parsed = to_timestamp(c, dayfirst)
    if errors == "raise":
        parsed = F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c)).cast("timestamp_ntz")).otherwise(parsed)
    return F.date_format(parsed, java_pattern(target_format))


# Target type names and the Catalyst types behind them.
TARGET_TYPES = {
    "string": "string", "integer": "bigint", "float": "double", "decimal": "decimal(18,2)",
    "boolean": "boolean", "date": "timestamp_ntz",
}


def coerce_type(c: Column, target: str, errors: str = "coerce", dayfirst: bool = False) -> Column:
    if target not in TARGET_TYPES:
        raise ValueError(f"unknown type {target!r}")
    text = c.cast("string")
    if target == "string":
        return text
    if target in ("integer", "float", "decimal"):
        number = to_number(text)
        # a fraction is no integer: null when coercing, an error when raising
        done = F.when(number == F.floor(number), number.try_cast("bigint")) if target == "integer" else number.try_cast(TARGET_TYPES[target])
    elif target == "boolean":
        done = strip_ws(text).try_cast("boolean")
    else:
        done = to_timestamp(text, dayfirst)
    if errors == "raise":
        bad = c.isNotNull() & done.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {target}: "), text)).cast(TARGET_TYPES[target])).otherwise(done)
    if errors == "ignore":
        # one column has one type: values that do not parse keep the whole column as text
        return F.coalesce(done.cast("string"), text)
    return done


def entry_parts(c: Column) -> tuple[Column, Column]:
    """``3.2`` gives (3, 2); anything else gives nulls."""
    parts = F.split(strip_ws(c), r"\.")
    ok = strip_ws(c).rlike(r"^\d+\.\d+$")
    return (
        F.when(ok, F.try_element_at(parts, F.lit(1)).try_cast("int")),
        F.when(ok, F.try_element_at(parts, F.lit(2)).try_cast("int")),
    )


def positive_amount(c: Column) -> Column:
    number = to_number(c)
    return F.when(number > 0, number)


def json_safe(c: Column, dtype: str) -> Column:
    """NaN and infinities become null, timestamps become ISO text."""
    if dtype in ("double", "float"):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if dtype.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.date_format(c, "yyyy-MM-dd") if dtype == "date" else c


def record_hash(df_columns: list[str], volatile: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the record as JSON with keys in order, without the volatile ones."""
    kept = sorted(c for c in df_columns if c not in volatile)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in kept]), {"ignoreNullFields": "false"}), 256)


def event_key(given: Column, scope: Column, payload: Column) -> Column:
    """The given id, else one derived from scope and payload hash."""
    usable = F.nullif(strip_ws(given.cast("string")), F.lit(""))
    return F.coalesce(usable, F.concat(F.lit("callback:"), scope.cast("string"), F.lit(":"), F.sha2(payload, 256)))


def merge_json_maps(old: Column, new: Column, protected: tuple[str, ...]) -> Column:
    """New keys win, but protected keys are only ever taken from the old map."""
    incoming = F.map_filter(new, lambda k, _: ~k.isin(*protected)) if protected else new
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(incoming, k))
    return F.map_concat(kept, incoming)
