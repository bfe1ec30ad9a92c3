"""Data-quality rules, ledger check and definition checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import quality as Q
from tablewright.operators.ordered import number_rows
from tablewright.operators.quality import Rule
from tablewright.queries.base import query, table, view

NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LEDGER_ORDER = ["voucher_id", "line_no", "part_id", "supp_id", "debit_amount", "credit_amount"]


def num(c):
    return f"CASE WHEN regexp_matches({STRIP.format(c)}, {NUM}) THEN cast({STRIP.format(c)} AS double) END"


def stamp(c):
    """The two layouts that occur in the sheet and the ledger."""
    return (f"coalesce(try_strptime(CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {c} END, '%Y-%m-%d'), "
            f"try_strptime(CASE WHEN regexp_matches({c}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN {c} END, '%m/%d/%Y'), "
            f"try_strptime(CASE WHEN regexp_matches({c}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN {c} END, '%d/%m/%Y'))")


def compact(c):
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def stated(rule) -> str:
    """Severity the SQL side expects, written out here so that the rules' own defaults are checked."""
    return rule.severity or {"required": "error", "unique": "error", "not_allowed_values": "error", "cross_field_compare": "error"}.get(rule.rule, "warning")


def rule_sql(rule: Rule, bad: str, shown: str | None = None, source="sheet", order="id"):
    return f"""SELECT '{rule.column}' AS "column", '{rule.rule}' AS rule, '{stated(rule)}' AS severity, '{rule.reason}' AS reason,
  count(*) AS invalid_count, array_to_string((list({shown or rule.column} ORDER BY {order}))[1:3], '|') AS samples
FROM {source} WHERE {bad} HAVING count(*) > 0"""


def flat(df):
    return df.withColumn("samples", F.array_join("samples", "|"))


def rule_query(name, rules, now=None):
    """rules: list of (Rule, bad SQL, shown SQL)."""

    @query(name, "\nUNION ALL\n".join(rule_sql(*r) for r in rules), uses=("sheet",))
    def run(spark, sf):
        return flat(Q.validate(view(spark, sf, "sheet"), [r[0] for r in rules], ["id"], now))


SHEET_TEXT = ("full_name", "segment", "balance_text", "quantity_text", "joined_text", "gender", "email", "active_text")


@query("v01_forbidden_substring", "\nUNION ALL\n".join(
    rule_sql(Rule(c, "forbidden_substring", reason="no fragments"), f"contains({compact(c)}, 'male')") for c in SHEET_TEXT), uses=("sheet",))
def forbidden(spark, sf):
    df = view(spark, sf, "sheet").select("id", *SHEET_TEXT)
    return flat(Q.validate(df, [Rule("*", "forbidden_substring", reason="no fragments", value="Ma-Le")], ["id"]))


rule_query("v02_required", [(Rule("segment", "required", "error"), f"segment IS NULL OR {STRIP.format('segment')} = ''", "coalesce(segment, NULL)")])


@query("v03_unique", f"""
WITH g AS (SELECT {STRIP.format('segment')} AS v, count(*) AS n, min(id) AS first_id FROM sheet GROUP BY 1 HAVING v <> '' AND count(*) > 1)
SELECT 'segment' AS "column", 'unique' AS rule, 'error' AS severity, 'names are keys' AS reason, cast(sum(n) AS BIGINT) AS invalid_count,
  array_to_string((list(v ORDER BY first_id))[1:3], '|') AS samples FROM g""", uses=("sheet",))
def unique(spark, sf):
    return flat(Q.validate(view(spark, sf, "sheet"), [Rule("segment", "unique", "error", "names are keys")], ["id"]))


rule_query("v04_non_negative", [(Rule("balance_text", "non_negative"), f"{num('balance_text')} < 0", None)])
rule_query("v05_numeric_range", [(Rule("balance_text", "numeric_range", low=100, high=5000),
                                  f"balance_text IS NOT NULL AND coalesce({num('balance_text')} < 100 OR {num('balance_text')} > 5000, true)", None)])
rule_query("v06_percentage_range", [(Rule("balance_text", "percentage_range"), f"({num('balance_text')} < 0 OR {num('balance_text')} > 100)", None)])
rule_query("v07_date_not_future", [(Rule("joined_text", "date_not_future"), f"{stamp('joined_text')} > TIMESTAMP '2020-06-01'",
                                    f"strftime({stamp('joined_text')}, '%Y-%m-%dT%H:%M:%S')")], now="2020-06-01 00:00:00")
rule_query("v08_date_range", [(Rule("joined_text", "date_range", low="2012-01-01", high="2019-12-31"),
                               f"joined_text IS NOT NULL AND coalesce({stamp('joined_text')} < '2012-01-01' OR {stamp('joined_text')} > '2019-12-31', true)", None)])
rule_query("v09_starts_ends_with", [
    (Rule("full_name", "starts_with", value="Customer"), "NOT starts_with(full_name, 'Customer')", None),
    (Rule("balance_text", "ends_with", value="USD"), "NOT suffix(balance_text, 'USD')", None)])
rule_query("v10_contains", [(Rule("segment", "contains", value="In"), f"NOT contains({compact('segment')}, 'in')", None)])
rule_query("v11_regex_match", [(Rule("joined_text", "regex_match", value=r"\d{4}-"), r"NOT regexp_matches(joined_text, '^(?:\d{4}-)')", None)])
rule_query("v12_allowed_values", [(Rule("gender", "allowed_values", values=("m", "male")), "upper(gender) NOT IN ('M', 'MALE')", None)])
rule_query("v13_not_allowed_values", [(Rule("active_text", "not_allowed_values", values=("maybe",)), "upper(active_text) IN ('MAYBE')", None)])
rule_query("v14_length_range", [
    (Rule("balance_text", "length_range", low=6, high=8), "length(balance_text) < 6 OR length(balance_text) > 8", None),
    (Rule("gender", "length_range", high=4), "length(gender) > 4", None)])
rule_query("v15_cross_field", [(Rule("visits", "cross_field_compare", "error", compare_column="nation", operator="<="), "NOT (visits <= nation)",
                                "concat(visits, ' / ', nation)")])

FILTERS = [{"mode": "keep", "column": "gender", "op": "in", "value": ["male", "m"]},
           {"mode": "drop", "column": "segment", "op": "contains", "value": "build"},
           {"mode": "drop", "column": "active_text", "op": "eq", "value": "no"}]


@query("v16_rules_from_filters", "\nUNION ALL\n".join([
    rule_sql(Rule("gender", "allowed_values", reason="Instruction filters on gender."), "upper(gender) NOT IN ('MALE', 'M')"),
    rule_sql(Rule("segment", "forbidden_substring", reason="Instruction filters on segment."), f"contains({compact('segment')}, 'build')"),
    rule_sql(Rule("active_text", "not_allowed_values", "warning", reason="Instruction filters on active_text."), "upper(active_text) = 'NO'")]), uses=("sheet",))
def from_filters(spark, sf):
    return flat(Q.validate(view(spark, sf, "sheet"), Q.rules_from_filters(FILTERS), ["id"]))


@query("v17_ledger_missing_columns", """
SELECT missing FROM (SELECT unnest(['class', 'country', 'details', 'region', 'sub_account', 'sub_class']) AS missing) WHERE EXISTS (SELECT 1 FROM ledger)""",
       uses=("ledger",))
def ledger_missing(spark, sf):
    df = view(spark, sf, "ledger")
    filled = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return filled.select(F.explode(F.array(*[F.lit(c) for c in Q.ledger_missing_columns(df)])).alias("missing"))


NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in LEDGER_ORDER)}) + 1 AS row FROM ledger)"


def numbered_ledger(spark, sf):
    """File rows start at 2 because row 1 is the header."""
    df = number_rows(view(spark, sf, "ledger"), LEDGER_ORDER, tie=[], out="row")
    return df.withColumn("row", F.col("row") + 1)


def first_rows(field, message, bad):
    return f"(SELECT row, '{field}' AS field, '{message}' AS message FROM {NUMBERED} WHERE {bad} ORDER BY row LIMIT 25)"


def ledger_query(name, fields, message_part, parts):
    @query(name, "\nUNION ALL\n".join(f"SELECT * FROM {first_rows(*p)}" for p in parts), uses=("ledger",))
    def run(spark, sf):
        return Q.ledger_errors(numbered_ledger(spark, sf), "row", fields, message_part).drop("check_no")


MISSING = "Required value is missing"
BOTH = "debit_amount/credit_amount"
D, CR = num("debit_amount"), num("credit_amount")
NOT_DATE = f"voucher_date IS NOT NULL AND {stamp('voucher_date')} IS NULL"
NOT_ENTRY = rf"entry_no IS NOT NULL AND NOT regexp_matches({STRIP.format('entry_no')}, '^\d+\.\d+$')"
ledger_query("v18_ledger_required", [], MISSING, [(c, MISSING, f"{c} IS NULL OR {STRIP.format(c)} = ''") for c in ("voucher_date", "entry_no", "account_code")])
ledger_query("v19_ledger_dates", ["voucher_date"], "valid date", [("voucher_date", "Must be a valid date", NOT_DATE)])
ledger_query("v20_ledger_entry_no", ["entry_no"], "format", [("entry_no", "Must be in format ''N.N''", NOT_ENTRY)])
ledger_query("v21_ledger_one_side", [BOTH], "Each row", [
    (BOTH, "Each row must have at least one of debit_amount or credit_amount", "debit_amount IS NULL AND credit_amount IS NULL"),
    (BOTH, "Each row must have only one of debit_amount or credit_amount, not both", "debit_amount IS NOT NULL AND credit_amount IS NOT NULL")])
ledger_query("v22_ledger_amounts", ["debit_amount", "credit_amount"], "Must be", [
    ("debit_amount", "Must be numeric", f"debit_amount IS NOT NULL AND {D} IS NULL"), ("debit_amount", "Must be greater than zero", f"{D} <= 0"),
    ("credit_amount", "Must be numeric", f"credit_amount IS NOT NULL AND {CR} IS NULL"), ("credit_amount", "Must be greater than zero", f"{CR} <= 0")])

CHECKS = [*[f"{c} IS NULL OR {STRIP.format(c)} = ''" for c in ("voucher_date", "entry_no", "account_code")], NOT_DATE, NOT_ENTRY,
          "debit_amount IS NULL AND credit_amount IS NULL", "debit_amount IS NOT NULL AND credit_amount IS NOT NULL",
          f"debit_amount IS NOT NULL AND {D} IS NULL", f"{D} <= 0", f"credit_amount IS NOT NULL AND {CR} IS NULL", f"{CR} <= 0"]


@query("v23_ledger_verdict", f"""
SELECT 'sub_account, details, class, sub_class, country, region' AS missing_columns, {' + '.join(f'count(*) FILTER ({c})' for c in CHECKS)} AS errors,
  least({' + '.join(f'least(count(*) FILTER ({c}), 25)' for c in CHECKS)}, 100) AS reported, false AS valid FROM ledger""", uses=("ledger",))
def ledger_verdict(spark, sf):
    return Q.ledger_verdict(view(spark, sf, "ledger"))


@query("v24_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return Q.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v24_missing_comments", """
SELECT id, active_text FROM sheet WHERE NOT coalesce(active_text = 'complete' OR length(trim(coalesce(segment, ''))) > 0, false)""", uses=("sheet",))
def missing_comments(spark, sf):
    return Q.missing_comments(view(spark, sf, "sheet"), "active_text", "segment").select("id", "active_text")


DEFS = """SELECT l_orderkey AS plan_id, l_partkey * 1000 + l_suppkey AS def_no, CASE WHEN l_returnflag = 'R' THEN 'drop' ELSE 'project' END AS kind,
  {array}(concat('c', cast(l_partkey % 6 AS string)), concat('c', cast(l_suppkey % 6 AS string))) AS cols FROM {{lineitem}}"""


def definitions(spark, sf):
    return spark.sql(DEFS.format(array="array"), lineitem=table(spark, sf, "lineitem"))


DEFS_SQL = DEFS.format(array="list_value").replace("{lineitem}", "lineitem")


@query("j09_contradictions", f"""
SELECT plan_id, "column", count(*) FILTER (kind = 'project') AS project_definitions, count(*) FILTER (kind = 'drop') AS drop_definitions
FROM (SELECT plan_id, kind, unnest(list_distinct(cols)) AS "column" FROM ({DEFS_SQL}))
GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'project') > 0 AND count(*) FILTER (kind = 'drop') > 0""")
def contradictions(spark, sf):
    return Q.contradictions(definitions(spark, sf), "plan_id", "kind", "cols")


@query("d07_repeated_definitions", f"""
SELECT plan_id, kind, array_to_string(list_sort(list_distinct(cols)), ',') AS "columns", min(def_no) AS first_no, count(*) AS n
FROM ({DEFS_SQL}) GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def repeated_definitions(spark, sf):
    return Q.repeated_definitions(definitions(spark, sf), "plan_id", "def_no", "kind", "cols")


KEY = "concat('k', cast(event_id % CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 7 END AS string))"


@query("j10_absent_keys", f"""
SELECT event_type, key FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(['k0', 'k3', 'k5', 'k9']) AS key) r
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND {KEY} = r.key)""")
def absent_keys(spark, sf):
    observed = table(spark, sf, "events").select("event_type", F.expr(KEY).alias("key"))
    return Q.absent_keys(observed, "event_type", "key", ["k0", "k3", "k5", "k9"])
