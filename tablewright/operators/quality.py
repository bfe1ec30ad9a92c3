"""Declarative data-quality rules, the ledger check, key constraints, and definition checks.

All row rules of a call are counted in one aggregation over one scan. Samples come from a second pass that
keeps three rows per rule before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators.rows import first_per_key

SAMPLES = 3


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    severity: str | None = None  # None: error for the rules in ERRORS, else warning
    reason: str = ""
    value: str | None = None
    values: Sequence[str] = ()
    low: object = None
    high: object = None
    compare_column: str | None = None
    operator: str | None = None

    @property
    def level(self) -> str:
        return self.severity or ("error" if self.rule in ERRORS else "warning")


# Rules whose violations are errors unless stated otherwise.
ERRORS = ("required", "unique", "not_allowed_values", "cross_field_compare")

COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def _outside(x: Column, low, high, kind: str) -> Column:
    bad = x.isNull()
    if low is not None:
        bad = bad | (x < F.lit(low).cast(kind))
    if high is not None:
        bad = bad | (x > F.lit(high).cast(kind))
    return bad


def violation(rule: Rule, now: str | None = None) -> Column:
    """Never-null test that is true for a value that breaks the rule. Nulls only break ``required``.

    Blank fragments and empty value lists state no rule: nothing breaks them.
    """
    c = F.col(rule.column).cast("string")
    number = V.to_number(c)
    fragment = "".join(ch for ch in (rule.value or "").lower() if ch.isascii() and ch.isalnum())
    upper = [v.strip().upper() for v in rule.values if v is not None and v.strip()]
    if (rule.rule in ("forbidden_substring", "contains") and not fragment) or (rule.rule in ("allowed_values", "not_allowed_values") and not upper):
        return F.lit(False)
    match rule.rule:
        case "required":
            return c.isNull() | (X.strip_ws(c) == "")
        case "forbidden_substring":
            bad = F.contains(X.compact_form(c), F.lit(fragment))
        case "non_negative":
            bad = number < 0
        case "numeric_range":
            bad = c.isNotNull() & _outside(number, rule.low, rule.high, "double")
        case "percentage_range":
            bad = (number < 0) | (number > 100)
        case "date_not_future":
            if now is None:
                raise ValueError("date_not_future needs now: results must not depend on the wall clock")
            bad = V.to_timestamp(c) > F.lit(now).cast("timestamp_ntz")
        case "date_range":
            bad = c.isNotNull() & _outside(V.to_timestamp(c), rule.low, rule.high, "timestamp_ntz")
        case "starts_with":
            bad = ~F.startswith(c, F.lit(rule.value))
        case "ends_with":
            bad = ~F.endswith(c, F.lit(rule.value))
        case "contains":
            bad = ~F.contains(X.compact_form(c), F.lit(fragment))
        case "regex_match":
            bad = ~c.rlike(f"^(?:{rule.value})")
        case "allowed_values":
            bad = ~F.upper(c).isin(upper)
        case "not_allowed_values":
            bad = F.upper(c).isin(upper)
        case "length_range":
            bad = F.lit(False)
            if rule.low is not None:
                bad = bad | (F.length(c) < int(rule.low))
            if rule.high is not None:
                bad = bad | (F.length(c) > int(rule.high))
        case "cross_field_compare":
            bad = ~COMPARE[rule.operator](number, V.to_number(F.col(rule.compare_column).cast("string")))
        case _:
            raise ValueError(f"unknown rule {rule.rule!r}")
    return F.coalesce(bad, F.lit(False))


def _shown(rule: Rule) -> Column:
    c = F.col(rule.column).cast("string")
    if rule.rule == "cross_field_compare":
        return F.concat_ws(" / ", c, F.col(rule.compare_column).cast("string"))
    if rule.rule == "date_not_future":
        return F.date_format(V.to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss")
    return c


def _expand(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """A rule on ``*`` becomes one rule per column; rules on absent columns are left out."""
    out = []
    for r in rules:
        if r.column == "*":
            out += [replace(r, column=c) for c in df.columns]
        elif r.column in df.columns and (r.compare_column is None or r.compare_column in df.columns):
            out.append(r)
    return out


def _row_rules(df: DataFrame, rules: list[tuple[int, Rule]], order: list[str], now: str | None, shown: int) -> DataFrame:
    tests = {i: violation(r, now) for i, r in rules}
    counts = df.agg(*[F.count_if(t).alias(f"r{i}") for i, t in tests.items()]).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("rule_no"), F.col(f"r{i}").alias("invalid_count")) for i, _ in rules]))
    ).where("invalid_count > 0")
    broken = F.array(*[
        F.when(tests[i], F.struct(F.lit(i).alias("rule_no"), _shown(r).alias("sample"))) for i, r in rules])
    hits = df.select(*[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)],
                     F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("h")).select("*", "h.*").drop("h")
    firsts = first_per_key(hits, ["rule_no"], [F.asc(f"_o{n}") for n in range(len(order))] + [F.asc("sample")], shown, "_rn")
    samples = firsts.groupBy("rule_no").agg(  # ``shown`` rows per rule at most
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "sample"))), lambda s: s["sample"]).alias("samples"))
    return counts.join(samples, "rule_no", "left")


def _unique_rule(df: DataFrame, no: int, rule: Rule, order: list[str], shown: int) -> DataFrame:
    """Members of repeated values, counted with map-side combine; blanks are ignored."""
    value = X.strip_ws(F.col(rule.column).cast("string"))
    groups = (
        df.select(value.alias("sample"), (F.col(order[0]) if len(order) == 1 else F.struct(*order)).alias("_at")).where(F.col("sample") != "")
        .groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at")).where("n > 1")
    )
    total = groups.agg(F.sum("n").alias("n")).scalar()
    firsts = groups.orderBy("_at", "sample").limit(shown).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "sample"))), lambda s: s["sample"]).alias("samples"))
    return firsts.select(F.lit(no).alias("rule_no"), total.alias("invalid_count"), "samples").where("invalid_count > 0")


def validate(df: DataFrame, rules: Sequence[Rule], order: list[str], now: str | None = None, shown: int = SAMPLES) -> DataFrame:
    """One row per broken rule: column, rule, severity, reason, invalid_count, samples (the first ``shown``)."""
    numbered = list(enumerate(_expand(df, rules)))
    if not numbered:
        return df.sparkSession.createDataFrame([], "column string, rule string, severity string, reason string, invalid_count bigint, samples array<string>")
    row_rules = [(i, r) for i, r in numbered if r.rule != "unique"]
    parts = [_row_rules(df, row_rules, order, now, shown)] if row_rules else []
    parts += [_unique_rule(df, i, r, order, shown) for i, r in numbered if r.rule == "unique"]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # the rule list is code, so naming each result needs no join
    facts = F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(r.rule).alias("rule"),
                               F.lit(r.level).alias("severity"), F.lit(r.reason).alias("reason")) for _, r in numbered])
    named = found.withColumn("_f", F.element_at(facts, F.col("rule_no") + 1))
    return named.select("_f.column", "_f.rule", "_f.severity", "_f.reason", "invalid_count", "samples")


def rules_from_filters(filters: Sequence[dict]) -> list[Rule]:
    """Rules that restate keep / drop filters: {mode, column, op, value(s)}."""
    out = []
    for f in filters:
        keep = f.get("mode", "keep") == "keep"
        reason = f"Instruction filters on {f['column']}."
        if f["op"] == "contains":
            out.append(Rule(f["column"], "contains" if keep else "forbidden_substring", "warning", reason, str(f["value"])))
        elif f["op"] in ("eq", "equals", "in", "one_of"):
            given = f["value"] if isinstance(f["value"], (list, tuple)) else [f["value"]]
            out.append(Rule(f["column"], "allowed_values" if keep else "not_allowed_values", "warning", reason,
                            values=tuple(str(v) for v in given)))
    return out


# -- ledger ---------------------------------------------------------------------------------------------------

# Columns a ledger must have; only one of the two amounts is filled per row.
LEDGER_REQUIRED = ("voucher_date", "entry_no", "sub_account", "details", "account_code", "class", "sub_class", "country", "region")
LEDGER_AMOUNTS = ("debit_amount", "credit_amount")
ROWS_PER_CHECK = 25
ROWS_PER_REPORT = 100


def ledger_missing_columns(df: DataFrame) -> list[str]:
    have = {c.strip().lower() for c in df.columns}
    return [c for c in LEDGER_REQUIRED + LEDGER_AMOUNTS if c not in have]


def _parsed_ledger(df: DataFrame) -> DataFrame:
    """Each text is stripped and parsed once; the checks then only compare columns."""
    parsed = {f"_s_{c}": X.strip_ws(F.col(c)) for c in LEDGER_REQUIRED if c in df.columns}
    if "voucher_date" in df.columns:
        parsed["_date"] = V.to_timestamp(F.col("voucher_date"))
    parsed |= {f"_n_{c}": V.to_number(F.col(c)) for c in LEDGER_AMOUNTS if c in df.columns}
    return df.withColumns(parsed)


def ledger_checks(df: DataFrame) -> list[tuple[str, str, Column]]:
    """(field, message, test) for every check the columns at hand allow, over ``_parsed_ledger``."""
    checks = []
    for c in LEDGER_REQUIRED:
        if c in df.columns:
            checks.append((c, "Required value is missing", F.col(c).isNull() | (F.col(f"_s_{c}") == "")))
    if "voucher_date" in df.columns:
        checks.append(("voucher_date", "Must be a valid date", F.col("voucher_date").isNotNull() & F.col("_date").isNull()))
    if "entry_no" in df.columns:
        checks.append(("entry_no", "Must be in format 'N.N'", ~F.col("_s_entry_no").rlike(r"^\d+\.\d+$")))
    if set(LEDGER_AMOUNTS) <= set(df.columns):
        d, c = F.col("debit_amount"), F.col("credit_amount")
        both = "debit_amount/credit_amount"
        checks.append((both, "Each row must have at least one of debit_amount or credit_amount", d.isNull() & c.isNull()))
        checks.append((both, "Each row must have only one of debit_amount or credit_amount, not both", d.isNotNull() & c.isNotNull()))
        for name in LEDGER_AMOUNTS:
            checks.append((name, "Must be numeric", F.col(name).isNotNull() & F.col(f"_n_{name}").isNull()))
            checks.append((name, "Must be greater than zero", F.col(f"_n_{name}") <= 0))
    return [(f, m, F.coalesce(t, F.lit(False))) for f, m, t in checks]


def ledger_errors(df: DataFrame, row: str, fields: Sequence[str] = (), message_part: str = "",
                  per_check: int | None = ROWS_PER_CHECK) -> DataFrame:
    """(check_no, row, field, message): the first ``per_check`` rows of each check in file order; None lists all."""
    chosen = [(i, *c) for i, c in enumerate(ledger_checks(df)) if (not fields or c[0] in fields) and message_part in c[1]]
    facts = F.array(*[
        F.when(t, F.struct(F.lit(i).alias("check_no"), F.lit(f).alias("field"), F.lit(m).alias("message"))) for i, f, m, t in chosen])
    found = _parsed_ledger(df).select(F.col(row).alias("row"), F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("e")).select("row", "e.*")
    if per_check is None:
        return found.select("check_no", "row", "field", "message")
    return first_per_key(found, ["check_no"], [F.asc("row")], per_check).select("check_no", "row", "field", "message")


def ledger_verdict(df: DataFrame, per_check: int | None = ROWS_PER_CHECK, per_report: int | None = ROWS_PER_REPORT) -> DataFrame:
    """One row from one scan: missing columns, number of errors found, number a report of these limits lists (None: no limit), valid flag."""
    checks = ledger_checks(df)
    missing = ledger_missing_columns(df)
    counts = _parsed_ledger(df).agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(t).alias(f"c{i}") for i, (_, _, t) in enumerate(checks)])
    all_errors = sum((F.col(f"c{i}") for i in range(len(checks))), F.lit(0))
    listed = sum((F.col(f"c{i}") if per_check is None else F.least(F.col(f"c{i}"), F.lit(per_check)) for i in range(len(checks))), F.lit(0))
    return counts.select(
        F.lit(", ".join(missing)).alias("missing_columns"), all_errors.cast("bigint").alias("errors"),
        (listed if per_report is None else F.least(listed, F.lit(per_report))).cast("bigint").alias("reported"),
        (F.lit(not missing) & (all_errors == 0) & (F.col("_rows") > 0)).alias("valid"))


# -- keys and definitions -------------------------------------------------------------------------------------

def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_comments(df: DataFrame, action: str, comment: str) -> DataFrame:
    """Every action but ``complete`` needs a comment."""
    ok = (F.col(action) == "complete") | (F.length(F.trim(F.coalesce(F.col(comment), F.lit("")))) > 0)
    return df.where(~F.coalesce(ok, F.lit(False)))


def repeated_definitions(df: DataFrame, scope: str, no: str, kind: str, cols: str) -> DataFrame:
    """Definitions of one kind over the same set of columns within a scope: first number and count."""
    same = F.array_join(F.array_sort(F.array_distinct(F.col(cols))), ",")
    return df.groupBy(scope, kind, same.alias("columns")).agg(
        F.min(no).alias("first_no"), F.count(F.lit(1)).alias("n")).where("n > 1")


def contradictions(df: DataFrame, scope: str, kind: str, cols: str, kinds: tuple[str, str] = ("project", "drop")) -> DataFrame:
    """Columns that one definition keeps and another drops, with the number of definitions on each side.

    Counting per (scope, column) finds every overlap without pairing definitions with each other.
    """
    a, b = kinds
    each = df.select(scope, kind, F.explode(F.array_distinct(F.col(cols))).alias("column"))
    return each.groupBy(scope, "column").agg(
        F.count_if(F.col(kind) == a).alias(f"{a}_definitions"), F.count_if(F.col(kind) == b).alias(f"{b}_definitions")
    ).where((F.col(f"{a}_definitions") > 0) & (F.col(f"{b}_definitions") > 0))


def absent_keys(observed: DataFrame, scope: str, key: str, required: list[str]) -> DataFrame:
    """Required keys that a scope never has."""
    seen = observed.select(scope, key).distinct()
    wanted = observed.select(scope).distinct().select(scope, F.explode(F.array(*[F.lit(r) for r in required])).alias(key))
    return wanted.join(seen, [scope, key], "left_anti")


PIECE = 1000


def uncovered_spans(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Stretches of each text that no span covers and that hold more than white space.

    ``texts``: key, text, n_chars. ``spans``: key, span_start, span_end with half-open offsets.
    """
    from tablewright.operators.ordered import running_max

    seen = running_max(spans, "span_end", ["span_start", "span_end"], [key], tie=[], out="reached")
    between = seen.select(key, F.coalesce("reached", F.lit(0)).alias("gap_start"), F.col("span_start").alias("gap_end"))
    ends = spans.groupBy(key).agg(F.max("span_end").alias("_e"))
    tail = texts.select(key, "n_chars").join(ends, key, "left").select(
        key, F.coalesce("_e", F.lit(0)).alias("gap_start"), F.col("n_chars").alias("gap_end"))
    gaps = between.unionByName(tail).where("gap_end > gap_start")
    # texts are cut into pieces so that a long text with many gaps is neither copied per gap nor read by one task
    pieces = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_p", "_piece"))
    first, last = F.floor(F.col("gap_start") / PIECE).cast("int"), F.floor((F.col("gap_end") - 1) / PIECE).cast("int")
    parts = gaps.select("*", F.explode(F.sequence(first, last)).alias("_p"))
    start = F.greatest(F.col("gap_start") - F.col("_p") * PIECE, F.lit(0))
    end = F.least(F.col("gap_end") - F.col("_p") * PIECE, F.lit(PIECE))
    inside = F.col("_piece").substr((start + 1).cast("int"), (end - start).cast("int"))
    filled = parts.join(pieces, [key, "_p"]).where(inside.rlike(r"\S"))
    return filled.select(key, "gap_start", "gap_end").distinct()
