"""Row predicates as Columns.

A null cell fails positive tests (the test is null, which a filter drops) and passes negative ones. Plain
comparisons are left bare so that they reach the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import compact_form, word_form

ORDERED_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")

# Accepted spellings of each operator.
OPERATOR_SYNONYMS = {
    "eq": ("=", "==", "is", "equals", "equal", "equal_to", "is_equal", "is_equal_to"),
    "neq": ("!=", "<>", "ne", "not_equal", "not_equals", "not_equal_to"),
    "gt": (">", "greater", "greater_than", "more_than", "above"),
    "gte": (">=", "ge", "at_least", "not_less_than", "greater_equal", "greater_than_or_equal", "greater_than_or_equal_to"),
    "lt": ("<", "less", "less_than", "below"),
    "lte": ("<=", "le", "at_most", "not_more_than", "less_equal", "less_than_or_equal", "less_than_or_equal_to"),
    "contains": (),
    "not_contains": ("does_not_contain",),
    "starts_with": (),
    "ends_with": (),
    "matches": ("like", "regex", "regexp"),
    "between": ("range", "in_range", "within"),
    "in": ("one_of", "belongs_to", "member_of", "contains_any", "in_list"),
    "not_in": ("nin", "not_one_of", "not_in_list"),
    "is_null": ("isnull", "null", "missing", "empty"),
    "is_not_null": ("notnull", "not_null", "present", "not_empty"),
}
SYNONYM_TO_OPERATOR = {s: op for op, names in OPERATOR_SYNONYMS.items() for s in (op, *names)}

# The opposite of each operator, used by drop mode on single conditions.
NEGATED = {
    "eq": "neq", "neq": "eq", "gt": "lte", "lte": "gt", "lt": "gte", "gte": "lt", "contains": "not_contains",
    "not_contains": "contains", "in": "not_in", "not_in": "in", "is_null": "is_not_null", "is_not_null": "is_null",
}


def canonical_operator(name: str) -> str:
    key = "_".join(name.strip().lower().replace("-", " ").split())
    if key not in SYNONYM_TO_OPERATOR:
        raise ValueError(f"unknown operator {name!r}")
    return SYNONYM_TO_OPERATOR[key]


def canonical_operator_column(c: Column) -> Column:
    """The same lookup over a column of a rule table; unknown words give null."""
    key = F.regexp_replace(F.trim(F.lower(c)), r"[\s\-]+", "_")
    pairs = [F.lit(x) for kv in SYNONYM_TO_OPERATOR.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_ordered(dtype: str) -> bool:
    return dtype.startswith(ORDERED_TYPES)


def equals(c: Column, value, dtype: str = "string", case_sensitive: bool = False) -> Column:
    if dtype == "string" and isinstance(value, str) and not case_sensitive:
        return F.lower(F.trim(c)) == value.strip().lower()
    return c == F.lit(value)


def text_match(c: Column, values, mode: str = "eq", case_sensitive: bool = False) -> Column:
    """Match on the word form or on the compact form, so ``pay pal`` finds ``PayPal``."""
    words = c if case_sensitive else word_form(c)
    compact = F.regexp_replace(c, "[^A-Za-z0-9]+", "") if case_sensitive else compact_form(c)
    wanted = [str(v).strip() for v in values if v is not None and str(v).strip()]
    if not wanted:
        return F.lit(False)
    if not case_sensitive:
        as_words = [" ".join("".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in v.lower()).split()) for v in wanted]
    else:
        as_words = wanted
    as_compact = ["".join(ch for ch in v if ch.isascii() and ch.isalnum()) for v in (wanted if case_sensitive else as_words)]
    if mode == "eq":
        return _never_null(words.isin(as_words) | compact.isin(as_compact))
    test = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[mode]
    hits = [test(words, F.lit(w)) | test(compact, F.lit(k)) for w, k in zip(as_words, as_compact)]
    return _never_null(reduce(or_, hits))


def predicate(c: Column, dtype: str, operator: str, value=None, value_to=None, case_sensitive: bool = False) -> Column:
    op = canonical_operator(operator)
    text = c.cast("string")
    if op in ("gt", "gte", "lt", "lte", "between") and not is_ordered(dtype):
        raise TypeError(f"{op} needs a number or date column, got {dtype}")
    needle = None if value is None else str(value)
    if op in ("contains", "not_contains", "starts_with", "ends_with") and not case_sensitive:
        text, needle = F.lower(text), needle.lower()
    other = value if isinstance(value, Column) else F.lit(value) if not isinstance(value, (list, tuple, set)) else None
    match op:
        case "eq":
            return equals(c, value, dtype, case_sensitive)
        case "neq":
            return c.isNull() | ~equals(c, value, dtype, case_sensitive)
        case "gt":
            return c > other
        case "gte":
            return c >= other
        case "lt":
            return c < other
        case "lte":
            return c <= other
        case "between":
            if value_to is None:
                raise ValueError("between needs value_to")
            return c.between(value, value_to)
        case "contains":
            return F.contains(text, F.lit(needle))
        case "not_contains":
            return c.isNull() | ~F.contains(text, F.lit(needle))
        case "starts_with":
            return F.startswith(text, F.lit(needle))
        case "ends_with":
            return F.endswith(text, F.lit(needle))
        case "matches":  # a regular expression found anywhere in the text
            return c.cast("string").rlike(str(value) if case_sensitive else f"(?i){value}")
        case "in" | "not_in":
            hit = text_match(c, value, "eq", case_sensitive) if dtype == "string" else c.isin(list(value))
            return hit if op == "in" else c.isNull() | ~hit
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
    raise ValueError(op)


def combine(parts: list[Column], logic: str = "and") -> Column:
    if not parts:
        return F.lit(True)
    return reduce({"and": and_, "or": or_}[logic], parts)
