"""Profiles, samples, guesses, roles, fingerprints (Q01-Q13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import states as S
from tablewright.operators.columns import LEDGER_ALIASES
from tablewright.queries.base import query, table, view
from tablewright.session import shared_folder

SHEET = ("sheet",)
COLS = {"id": "bigint", "full_name": "string", "segment": "string", "balance_text": "string", "balance": "double", "gender": "string",
        "email": "string", "active_text": "string", "visits": "bigint", "notes": "string"}


def sheet(spark, sf):
    return view(spark, sf, "sheet").select(*COLS)


@query("q01_table_profile", """
SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE lineitem)) AS column_count, cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows, false AS large_table FROM lineitem""")
def table_profile(spark, sf):
    return P.table_profile(table(spark, sf, "lineitem"), size_bytes=1)


def column_sql(c, t, extra=""):
    number = t in ("bigint", "double")
    text = t == "string"
    return f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count,
  {f'cast(min({c}) AS double)' if number else 'cast(NULL AS double)'} AS numeric_min, {f'cast(max({c}) AS double)' if number else 'cast(NULL AS double)'} AS numeric_max,
  {f'round(avg(length({c})), 6)' if text else 'cast(NULL AS double)'} AS average_text_length FROM sheet"""


PROFILE_SQL = "\nUNION ALL\n".join(column_sql(c, t) for c, t in COLS.items())


def shown(df):
    return df.withColumn("average_text_length", F.round("average_text_length", 6)).drop("ordinal", "date_min", "date_max")


@query("q02_column_profile", PROFILE_SQL, uses=SHEET)
def column_profile(spark, sf):
    return shown(P.column_profile(sheet(spark, sf)))


@query("q02_date_columns", """
SELECT 'o_orderdate' AS "column", count(*) - count(o_orderdate) AS null_count, count(DISTINCT o_orderdate) AS distinct_count,
  strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS date_min, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS date_max FROM orders""")
def date_columns(spark, sf):
    return P.column_profile(table(spark, sf, "orders").select("o_orderdate")).select("column", "null_count", "distinct_count", "date_min", "date_max")


def masked(c):
    from tablewright.queries.cleaning import masked as mask_sql

    return mask_sql(c)


VALUE_COLS = ("segment", "balance_text", "gender", "email")


def samples_sql(order):
    cells = "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {c} AS value, id FROM sheet WHERE {c} IS NOT NULL" for c in VALUE_COLS)
    return f"""
WITH cells AS ({cells}), counts AS (SELECT "column", value, count(*) AS n, min(id) AS first FROM cells GROUP BY 1, 2)
SELECT "column", rank, CASE WHEN "column" = 'email' THEN {masked('value')} ELSE value END AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY {order}) AS rank FROM counts) WHERE rank <= 5"""


def samples(name, kind, order):
    @query(name, samples_sql(order) if order else None, uses=SHEET if order else ())
    def run(spark, sf):
        counts = P.value_counts(view(spark, sf, "sheet"), F.col("id"), list(VALUE_COLS))
        return P.sample_values(counts, kind)


samples("q03_representative_values", "representative", "first, value")
samples("q03_frequent_values", "frequent", "n DESC, first, value")
samples("q03_rare_values", "rare", "n, value")
samples("q04_random_values", "random", None)

# what the name hints and the first values say about each column of the sheet
GUESS = {"id": ("numeric", 0.85), "full_name": ("string", 0.6), "segment": ("categorical", 0.8), "balance_text": ("currency", 0.7),
         "balance": ("currency", 0.9), "gender": ("categorical", 0.75), "email": ("string", 0.6), "active_text": ("categorical", 0.75),
         "visits": ("numeric", 0.85), "notes": ("string", 0.5)}


def guesses(spark, sf):
    df = sheet(spark, sf)
    return P.semantic_guesses(P.column_profile(df), P.head_shares(df, F.col("id")))


HEADS = "SELECT avg(cast(regexp_matches(balance_text, '[$€£¥₹]') AS INTEGER)) AS s FROM (SELECT balance_text FROM sheet WHERE balance_text IS NOT NULL ORDER BY id LIMIT 20)"
GUESS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{g}' AS semantic_guess, {f'CASE WHEN ({HEADS}) >= 0.5 THEN 0.85 ELSE 0.7 END' if c == 'balance_text' else s}::DOUBLE AS confidence, "
    f"count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, avg(length(cast({c} AS string))) AS len FROM sheet"
    for c, (g, s) in GUESS.items())


@query("q05_semantic_guess", f'SELECT "column", semantic_guess, confidence FROM ({GUESS_SQL})', uses=SHEET)
def semantic_guess(spark, sf):
    return guesses(spark, sf).select("column", "semantic_guess", "confidence")


@query("q06_broad_type", f"""
SELECT "column", b AS broad_type, CASE WHEN confidence >= 0.9 THEN greatest(m, 0.9) ELSE m END AS match_score FROM (
  SELECT *, CASE b WHEN 'currency' THEN 0.95 WHEN 'numeric' THEN 0.95 WHEN 'identifier' THEN 0.92 WHEN 'categorical' THEN 0.75 WHEN 'free_text' THEN 0.7 ELSE 0.35 END::DOUBLE AS m FROM (
    SELECT *, CASE WHEN semantic_guess IN ('currency', 'numeric') THEN semantic_guess WHEN semantic_guess <> 'numeric' AND "column" <> 'id' AND NOT ("column" = 'notes') AND len >= 18 THEN 'free_text'
      WHEN distinct_count <= greatest(10, floor(greatest(non_null_count, 1) * 0.25)) THEN 'categorical' WHEN semantic_guess = 'categorical' THEN 'categorical' ELSE 'free_text' END AS b
    FROM ({GUESS_SQL})))""", uses=SHEET)
def broad_type(spark, sf):
    return P.broad_types(guesses(spark, sf)).select("column", "broad_type", "match_score")


@query("q07_column_role", f"""
SELECT "column", CASE WHEN "column" = 'id' THEN 'identifier' WHEN semantic_guess IN ('currency', 'numeric') THEN 'measure' WHEN semantic_guess = 'categorical' THEN 'categorical' ELSE 'text' END AS role,
  CASE WHEN "column" = 'id' THEN 0.9 WHEN semantic_guess IN ('currency', 'numeric') THEN 0.85 WHEN semantic_guess = 'categorical' THEN 0.8
    WHEN non_null_count > 0 AND distinct_count / non_null_count > 0.5 THEN 0.7 ELSE 0.6 END::DOUBLE AS role_confidence FROM ({GUESS_SQL})""", uses=SHEET)
def column_role(spark, sf):
    return P.column_roles(guesses(spark, sf)).select("column", "role", "role_confidence")


WORD = """concat(CASE l_partkey % 8 WHEN 0 THEN 'Order' WHEN 1 THEN 'invoice' WHEN 2 THEN 'payment' WHEN 3 THEN 'unit' WHEN 4 THEN 'debit' WHEN 5 THEN 'civil' WHEN 6 THEN 'posting' ELSE 'vendor' END, CASE l_suppkey % 3 WHEN 0 THEN '_' WHEN 1 THEN ' ' ELSE '-' END,
  CASE l_linenumber % 6 WHEN 0 THEN 'ID' WHEN 1 THEN 'date' WHEN 2 THEN 'Status' WHEN 3 THEN 'price' WHEN 4 THEN 'method' ELSE 'note' END)"""


def role_sql():
    words = "string_split(flat, '_')"
    cases = []
    for role, hints in P.ROLE_HINTS.items():
        tests = " OR ".join(f"list_has_all({words}, {[w for w in h.split('_')]!r})" for h in hints)
        cases.append(f"WHEN flat IN ({', '.join(repr(h) for h in hints)}) OR {tests} THEN '{role}'")
    return f"CASE {' '.join(cases)} END"


NAMES_SQL = f"SELECT name, n, replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS flat FROM (SELECT {WORD} AS name, count(*) AS n FROM lineitem GROUP BY 1)"


def requested_names(spark, sf):
    """Column names as users write them, one per line item, counted so that each distinct name is looked at once."""
    return table(spark, sf, "lineitem").groupBy(F.expr(WORD).alias("column")).agg(F.count(F.lit(1)).alias("n"))


@query("q08_business_role", f'SELECT name AS "column", n, {role_sql()} AS role FROM ({NAMES_SQL})')
def business_role(spark, sf):
    return requested_names(spark, sf).select("column", "n", P.business_role(F.col("column")).alias("role"))


def lean_sql(c):
    from tablewright.queries.quality import num

    t = f"cast({c} AS string)"
    return f"""SELECT '{c}' AS "column", count({c}) < count(*) AS nullable, count(*) - count({c}) AS null_count, count(DISTINCT nullif({t}, '')) AS distinct_count,
  min({num(t)}) AS min_number, max({num(t)}) AS max_number, CASE WHEN count({num(t)}) = 0 THEN min({t}) END AS min_text, CASE WHEN count({num(t)}) = 0 THEN max({t}) END AS max_text,
  (SELECT array_to_string((list(v ORDER BY f, v))[1:3], '|') FROM (SELECT {t} AS v, min(id) AS f FROM sheet WHERE {t} <> '' GROUP BY 1)) AS samples FROM sheet"""


LEAN = ("id", "segment", "balance_text", "visits", "gender")


@query("q09_lean_profile", "\nUNION ALL\n".join(lean_sql(c) for c in LEAN), uses=SHEET)
def lean_profile(spark, sf):
    return P.lean_profile(view(spark, sf, "sheet").select(*LEAN), F.col("id")).withColumn("samples", F.array_join("samples", "|"))


@query("q10_structure_fingerprint", f"""
SELECT sha256(to_json(list({{'name': lower("column"), 'dtype': dtype, 'nullable': null_count > 0}} ORDER BY "column"))::VARCHAR) AS fingerprint FROM ({PROFILE_SQL})""", uses=SHEET)
def structure(spark, sf):
    return P.structure_fingerprint(P.column_profile(sheet(spark, sf)))


def cells_sql():
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", cast({c} AS string) AS value, id FROM sheet WHERE {c} IS NOT NULL" for c in COLS)


@query("q11_profile_fingerprint", f"""
WITH p AS ({PROFILE_SQL}), cells AS ({cells_sql()}), counts AS (SELECT "column", value, count(*) AS n, min(id) AS first FROM cells GROUP BY 1, 2),
f AS (SELECT "column", rank, CASE WHEN "column" = 'email' THEN {masked('value')} ELSE value END AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first, value) AS rank FROM counts) WHERE rank <= 5),
t AS (SELECT "column", sha256(to_json(list({{'rank': rank, 'value': value}} ORDER BY rank))::VARCHAR) AS tops FROM f GROUP BY 1)
SELECT sha256(to_json(list({{'name': lower(p."column"), 'distinct_count': distinct_count, 'tops': coalesce(tops, '')}} ORDER BY p."column"))::VARCHAR) AS fingerprint
FROM p LEFT JOIN t ON t."column" = p."column\"""", uses=SHEET)
def fingerprint(spark, sf):
    df = sheet(spark, sf)
    return P.profile_fingerprint(P.column_profile(df), P.sample_values(P.value_counts(df, F.col("id")), "frequent"))


@query("q12_field_mapping", f"""
SELECT name AS "column", coalesce(CASE r {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ROLE_TARGETS.items())} END, name) AS target,
  CASE WHEN r IS NULL THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN r IS NULL THEN 'as is' ELSE 'name words' END AS reason
FROM (SELECT name, {role_sql()} AS r FROM ({NAMES_SQL}))""")
def field_mapping(spark, sf):
    return P.field_mapping(requested_names(spark, sf), tuple(dict.fromkeys(LEDGER_ALIASES.values())))


@query("q13_result_field_role", f"""
SELECT "column", CASE WHEN "column" = 'id' THEN 'identifier' WHEN dtype IN ('bigint', 'double') THEN 'measure'
  WHEN distinct_count < (null_count + non_null_count) * 0.5 THEN 'category' ELSE 'dimension' END AS field_role FROM ({PROFILE_SQL})""", uses=SHEET)
def field_role(spark, sf):
    return P.result_fields(P.column_profile(sheet(spark, sf))).select("column", "field_role")


def order_states(spark, sf):
    """States of the orders by year: the years up to 1999 first, later ones as a second load, 1999 once more as a corrected one."""
    orders = table(spark, sf, "orders").withColumn("part", F.year("o_orderdate"))
    path = shared_folder(spark)
    for load in (F.coalesce(F.col("part") < 2000, F.lit(True)), F.col("part") >= 2000, F.col("part") == 1999):
        S.refresh(orders.where(load), "part", path)
    return S.stored(spark, path)


ORDER_COLS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}


def states_sql(c, t):
    number, text, date = t in ("bigint", "double"), t == "string", t == "timestamp"
    day = "'%Y-%m-%dT%H:%M:%S'"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, count({c}) AS non_null_count,
  {f'cast(min({c}) AS double)' if number else 'cast(NULL AS double)'} AS numeric_min, {f'cast(max({c}) AS double)' if number else 'cast(NULL AS double)'} AS numeric_max,
  {f'strftime(min({c}), {day})' if date else 'cast(NULL AS varchar)'} AS date_min, {f'strftime(max({c}), {day})' if date else 'cast(NULL AS varchar)'} AS date_max,
  {f'round(avg(length({c})), 6)' if text else 'cast(NULL AS double)'} AS average_text_length FROM orders"""


@query("q02_profile_from_states", "\nUNION ALL\n".join(states_sql(c, t) for c, t in ORDER_COLS.items()))
def profile_from_states(spark, sf):
    exact = S.profile(order_states(spark, sf)).drop("ordinal", "dtype", "distinct_count", "quantiles")
    return exact.withColumn("average_text_length", F.round("average_text_length", 6))


@query("q02_estimates_from_states")  # sketches: held to their bounds by a test
def estimates_from_states(spark, sf):
    return S.profile(order_states(spark, sf)).select("column", "distinct_count", "quantiles")


STATE_VALUES = "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("o_orderstatus", "o_orderpriority"))


@query("q03_frequent_from_states", f"""
SELECT * FROM (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM ({STATE_VALUES})) WHERE rank <= 5""")
def frequent_from_states(spark, sf):
    return S.frequent_values(order_states(spark, sf).where(F.col("column").isin("o_orderstatus", "o_orderpriority")))
