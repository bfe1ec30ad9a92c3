"""Requested names and values against columns.

Requests come from the line items: one column name as a user may write it per row, counted first so that
each distinct name is scored once. The catalogue is the schema of the shared views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.operators import match as M
from tablewright.operators import profile as P
from tablewright.operators.rows import leaders as leader_rows
from tablewright.queries.base import query, table, view
from tablewright.queries.profiles import WORD, requested_names

# columns of the shared views, in order
CATALOGUE = ["id", "user_id", "status", "payload_status", "uploaded_at", "completed_at", "output_format", "file_name", "voucher_id", "voucher_date",
             "entry_no", "account_code", "debit_amount", "credit_amount", "full_name", "segment", "balance_text", "joined_text", "gender", "email",
             "visits", "orderDate", "unit_price", "paymentMethod", "customer_name"]
CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CATALOGUE)) + ') AS t(ordinal, "column"))'
REQ_SQL = f"req AS (SELECT {WORD} AS requested, count(*) AS n FROM lineitem GROUP BY 1)"


def requests(spark, sf):
    return requested_names(spark, sf).withColumnRenamed("column", "requested").withColumn("f", M.features(F.col("requested")))


def toks(c):
    return (rf"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[_\s]+'), lambda t: t <> '')")


def overlap_sql(a, b):
    x, y = f"list_distinct({toks(a)})", f"list_distinct({toks(b)})"
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


def similarity_sql(a, b):
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    return f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"


def best_sql(score, extra=""):
    return f"""WITH {REQ_SQL}, {CAT_SQL}, s AS (SELECT requested, n, "column", ordinal, round({score}, 9) AS score{extra} FROM req, cat)
SELECT requested, n, "column", score FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY score DESC, ordinal) AS rn FROM s) WHERE rn = 1"""


def best_of(name, score, sql_score):
    @query(name, best_sql(sql_score))
    def run(spark, sf):
        cat = M.name_catalogue(spark, CATALOGUE)
        return M.top_columns(requests(spark, sf), ["requested", "n"], cat, lambda c: F.round(score(F.col("f"), c["f"]), 9))


best_of("m01_token_overlap", M.token_overlap, overlap_sql("requested", '"column"'))
best_of("m02_name_similarity", M.name_similarity, similarity_sql("requested", '"column"'))
best_of("j07_best_candidate", lambda a, b: (M.token_overlap(a, b) + M.name_similarity(a, b)) / 2,
        f"({overlap_sql('requested', chr(34) + 'column' + chr(34))} + {similarity_sql('requested', chr(34) + 'column' + chr(34))}) / 2")


@query("m03_value_match", rf"""
WITH req AS (SELECT text, count(*) AS n FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN 'Building' WHEN 1 THEN 'female' WHEN 2 THEN 'red widget' WHEN 3 THEN 'others or male' ELSE 'nothing' END AS text FROM lineitem) GROUP BY 1),
cells AS (SELECT 0 AS ordinal, 'c_mktsegment' AS "column", c_mktsegment AS v, c_custkey AS f FROM customer UNION ALL SELECT 1, 'p_name', p_name, p_partkey FROM part
  UNION ALL SELECT 2, 'gender', CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' female' WHEN 2 THEN 'Others' ELSE 'male' END, c_custkey FROM customer),
vals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f, v) AS rn FROM (SELECT ordinal, "column", v, min(f) AS f FROM cells GROUP BY 1, 2, 3)) WHERE rn <= 5),
per AS (SELECT text, n, ordinal, "column", list(lower(trim(v))) AS vs FROM req, vals GROUP BY 1, 2, 3, 4),
s AS (SELECT text, n, ordinal, "column", CASE WHEN list_contains(vs, lower(trim(text))) THEN 1.0
    WHEN len(list_filter(vs, lambda v: list_has_all(string_split(v, ' '), string_split(lower(text), ' ')))) > 0 THEN 0.8
    ELSE 0.6 * len(list_intersect(list_distinct(string_split(lower(text), ' ')), flatten(list_transform(vs, lambda v: string_split(v, ' '))))) / len(list_distinct(string_split(lower(text), ' '))) END AS score FROM per)
SELECT text, n, "column", round(score, 9)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, ordinal) AS rn FROM s) WHERE rn = 1""")
def value_match(spark, sf):
    customer, part = table(spark, sf, "customer"), table(spark, sf, "part")
    gender = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' female' WHEN 2 THEN 'Others' ELSE 'male' END")
    tables = [(0, "c_mktsegment", P.value_counts(customer, F.col("c_custkey"), ["c_mktsegment"])), (1, "p_name", P.value_counts(part, F.col("p_partkey"), ["p_name"])),
              (2, "gender", P.value_counts(customer.withColumn("gender", gender), F.col("c_custkey"), ["gender"]))]
    entries = None
    for i, c, counts in tables:
        one = P.sample_values(counts, "representative").groupBy("column").agg(F.collect_list("value").alias("values")).withColumn("ordinal", F.lit(i))
        entries = one if entries is None else entries.unionByName(one)
    text = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'Building' WHEN 1 THEN 'female' WHEN 2 THEN 'red widget' WHEN 3 THEN 'others or male' ELSE 'nothing' END")
    asked = table(spark, sf, "lineitem").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    entries = entries.withColumn("v", M.value_features(F.col("values")))
    return M.top_columns(asked.withColumn("f", M.features(F.col("text"))), ["text", "n"], entries, lambda c: F.round(M.value_match(F.col("f"), c["v"]), 9))


KIND = "CASE l_partkey % 6 WHEN 0 THEN 'explicit_name' WHEN 1 THEN 'semantic_concept' WHEN 2 THEN 'value_implied' WHEN 3 THEN 'generic_reference' WHEN 4 THEN 'column_group' ELSE 'other' END"
ROLE = "CASE l_suppkey % 4 WHEN 0 THEN 'measure' WHEN 1 THEN 'dimension' WHEN 2 THEN 'categorical' ELSE 'text' END"


def align_sql(kind, role):
    whens = []
    for k, scores in M.ALIGNMENT.items():
        rest = scores["default"]
        inner = " ".join(f"WHEN {role} = '{r}' THEN {v}" for r, v in scores.items() if r != "default")
        whens.append(f"WHEN {kind} = '{k}' THEN {f'CASE {inner} ELSE {rest} END' if inner else rest}")
    return f"CASE {' '.join(whens)} ELSE {M.UNKNOWN_KIND} END::DOUBLE"


@query("m04_role_alignment", f"SELECT kind, role, count(*) AS n, {align_sql('kind', 'role')} AS score FROM (SELECT {KIND} AS kind, {ROLE} AS role FROM lineitem) GROUP BY 1, 2")
def role_alignment(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy(F.expr(KIND).alias("kind"), F.expr(ROLE).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("score", M.role_alignment(F.col("kind"), F.col("role")))


# catalogue entries with role, kind, broad type, tags and values as a profile would give them
ENTRIES = [
    ("transaction_id", "identifier", "numeric", "identifier", ("transaction", "id"), ("1001", "1002")),
    ("payment_method", "categorical", "categorical", "payment", ("payment", "method", "paypal", "cash"), ("paypal", "cash", "credit card")),
    ("payment_status", "categorical", "categorical", "status", ("payment", "status", "paid"), ("paid", "pending", "failed")),
    ("product_name", "text", "string", "product", ("product", "name"), ("red widget", "blue bolt")),
    ("unit_price", "measure", "currency", "currency", ("unit", "price"), ("10.5", "20.0")),
    ("order_date", "temporal", "date", "date", ("order", "date"), ("2024-01-01",)),
    ("c4", "categorical", "categorical", "categorical", ("c4", "completed", "open"), ("completed", "open")),
    ("note", "text", "string", "free_text", ("note",), ("free words",)),
]
SCORES = {"identifier": 0.92, "payment": 0.92, "status": 0.92, "product": 0.92, "currency": 0.95, "date": 0.95, "categorical": 0.75, "free_text": 0.7}


def entries(spark):
    facts = [{"column": c, "role": r, "guess": g, "broad_type": b, "tags": list(t), "values": list(v), "match_score": SCORES[b]} for c, r, g, b, t, v in ENTRIES]
    return M.catalogue(spark, facts).withColumn("v", M.value_features(F.col("values")))


ENTRY_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{r}', '{g}', '{b}', {list(t)!r}, {list(v)!r}, {SCORES[b]}::DOUBLE)" for i, (c, r, g, b, t, v) in enumerate(ENTRIES)) + \
    ') AS t(ordinal, "column", role, guess, broad_type, tags, "values", match_score))'


def value_sql(text, vs):
    t, lows = f"list_distinct({toks(text)})", f"list_transform({vs}, lambda v: lower(trim(v)))"
    return f"""CASE WHEN list_contains({lows}, lower(trim({text}))) THEN 1.0 WHEN len(list_filter({lows}, lambda v: list_has_all(string_split(v, ' '), {t}))) > 0 THEN 0.8
  ELSE 0.6 * len(list_intersect({t}, flatten(list_transform({lows}, lambda v: string_split(v, ' '))))) / len({t}) END"""


@query("m05_weighted_candidates", f"""
WITH {REQ_SQL}, {ENTRY_SQL}, d AS (SELECT requested, n, "column", ordinal, {overlap_sql('requested', '"column"')} AS token, {value_sql('requested', '"values"')} AS val,
    {align_sql("'semantic_concept'", 'role')} AS align, {similarity_sql('requested', '"column"')} AS sim FROM req, cat),
s AS (SELECT *, round((token * 0.25 + val * 0.25 + align * 0.25 + sim * 0.25) / 1.0, 9)::DOUBLE AS score FROM d)
SELECT requested, n, rank, "column", score, concat_ws(' ', concat('token=', CASE WHEN token > 0.5 THEN 'strong' WHEN token > 0 THEN 'partial' ELSE 'none' END),
  concat('value=', CASE WHEN val > 0.5 THEN 'strong' WHEN val > 0 THEN 'partial' ELSE 'none' END), concat('type=', CASE WHEN align > 0.6 THEN 'aligned' WHEN align <= 0.3 THEN 'misaligned' ELSE 'neutral' END),
  concat('name=', CASE WHEN sim > 0.7 THEN 'strong' WHEN sim > 0.3 THEN 'partial' ELSE 'none' END)) AS evidence
FROM (SELECT *, cast(row_number() OVER (PARTITION BY requested ORDER BY score DESC, ordinal) AS INTEGER) AS rank FROM s) WHERE rank <= 3""")
def weighted_candidates(spark, sf):
    f = F.col("f")

    def parts(c):
        return (M.token_overlap(f, c["f"]), M.value_match(f, c["v"]), M.role_alignment(F.lit("semantic_concept"), c["role"]), M.name_similarity(f, c["f"]))

    return M.top_columns(requests(spark, sf), ["requested", "n"], entries(spark), lambda c: F.round(M.weighted_score(*parts(c)), 9),
                         {"evidence": lambda c: M.evidence(*parts(c))}, k=3)


def flat_sql(c):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"


def sorted_sql(c):
    return rf"array_to_string(list_sort(string_split_regex(trim(lower({c})), '\s+')), ' ')"


SYNONYM_SQL = " OR ".join(f"(guess = '{k}' AND (lower(trim(requested)) IN {ws!r} OR {flat_sql('requested')} IN {ws!r}))" for k, ws in M.KIND_SYNONYMS.items())
FUZZY_SQL = f"(1 - levenshtein({sorted_sql('requested')}, {sorted_sql(chr(34) + 'column' + chr(34))})::DOUBLE / greatest(length({sorted_sql('requested')}), length({sorted_sql(chr(34) + 'column' + chr(34))})))"
TIER_SQL = f"""
WITH {REQ_SQL}, {ENTRY_SQL}, s AS (SELECT requested, n, ordinal, "column", round(CASE WHEN lower(trim(requested)) = lower("column") THEN 1.0 WHEN {flat_sql('requested')} = {flat_sql('"column"')} THEN 0.95
    WHEN {SYNONYM_SQL} THEN 0.85 ELSE {FUZZY_SQL} END, 9)::DOUBLE AS score,
  CASE WHEN lower(trim(requested)) = lower("column") THEN 'exact' WHEN {flat_sql('requested')} = {flat_sql('"column"')} THEN 'normalized' WHEN {SYNONYM_SQL} THEN 'synonym' WHEN {FUZZY_SQL} >= 0.75 THEN 'fuzzy' ELSE 'low' END AS tier FROM req, cat),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY score DESC, ordinal) AS rn FROM s) WHERE rn = 1)"""


def tiered(spark, sf):
    f = F.col("f")
    return M.top_columns(requests(spark, sf), ["requested", "n"], entries(spark), lambda c: F.round(M.tiered_match(f, c["f"], c["guess"])[0], 9),
                         {"tier": lambda c: M.tiered_match(f, c["f"], c["guess"])[1]})


@query("m06_tiered_match", TIER_SQL + '\nSELECT requested, n, "column", score, tier FROM best')
def tiered_match(spark, sf):
    return tiered(spark, sf)


@query("m07_low_confidence_policy", TIER_SQL + "\nSELECT requested, n, CASE WHEN score >= 0.75 THEN 'allow' ELSE 'quarantine' END AS verdict FROM best")
def policy(spark, sf):
    return tiered(spark, sf).select("requested", "n", M.low_confidence_policy(F.col("score"), "quarantine").alias("verdict"))


def written_sql(c):
    out = rf"trim(regexp_replace(regexp_replace(lower(trim({c})), '[_\-./]+', ' ', 'g'), '\s+', ' ', 'g'))"
    for a, b in M.ABBREVIATIONS:
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return out


CONCEPT_MAP = "MAP {" + ", ".join(f"'{k}': {list(v)!r}" for k, v in M.CONCEPTS.items()) + "}"


def concept_sql(c):
    words = f"string_split({c}, ' ')"
    return f"list_distinct(list_concat({words}, flatten(list_transform({words}, lambda w: coalesce(({CONCEPT_MAP})[w], [])))))"


@query("m08_concept_match", f"""
WITH {REQ_SQL}, {CAT_SQL}, r AS (SELECT requested, n, {written_sql('requested')} AS rw FROM req), c AS (SELECT ordinal, "column", {written_sql('"column"')} AS cw FROM cat),
rc AS (SELECT *, {concept_sql('rw')} AS rs FROM r), cc AS (SELECT *, {concept_sql('cw')} AS cs FROM c),
s AS (SELECT requested, n, ordinal, "column", len(list_intersect(rs, cs)) AS shared, len(list_intersect(rs, cs)) / least(len(rs), len(cs)) AS base, string_split(rw, ' ')[-1] = string_split(cw, ' ')[-1] AS same_last FROM rc, cc),
f AS (SELECT *, round(CASE WHEN shared = 0 THEN 0 WHEN same_last THEN least(base + 0.15, 1.0) ELSE base END, 9)::DOUBLE AS score FROM s)
SELECT requested, n, "column", score, round(CASE WHEN score >= 0.6 THEN least(0.9, 0.7 + score * 0.25) END, 9)::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY score DESC, ordinal) AS rn FROM f) WHERE rn = 1""")
def concept_match(spark, sf):
    best = M.top_columns(requests(spark, sf), ["requested", "n"], M.name_catalogue(spark, CATALOGUE), lambda c: F.round(M.concept_score(F.col("f"), c["f"]), 9))
    return best.withColumn("confidence", F.round(M.concept_confidence(F.col("score")), 9))


WANTED = "SELECT DISTINCT concat(substr(c_mktsegment, 1, 4), ' ', lower(substr(c_mktsegment, 5))) AS wanted FROM customer UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT upper(c_mktsegment) FROM customer"


def k_sql(c):
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


@query("m09_values_in_domain", f"""
WITH w AS ({WANTED}), seen AS (SELECT segment AS v, min(id) AS f FROM sheet WHERE segment IS NOT NULL GROUP BY 1),
h AS (SELECT wanted, v, f, trim(v) = trim(wanted) AS same, row_number() OVER (PARTITION BY wanted ORDER BY f, v) AS rn FROM w JOIN seen ON {k_sql('wanted')} = {k_sql('v')})
SELECT w.wanted, count(v) > 0 AS matched, CASE WHEN count(v) = 0 THEN 'unresolved' WHEN bool_or(same AND rn = 1) THEN 'exact' ELSE 'normalized' END AS match_kind, count(v) AS match_count,
  coalesce(array_to_string((list(v ORDER BY rn) FILTER (v IS NOT NULL))[1:5], '|'), '') AS samples FROM w LEFT JOIN h ON h.wanted = w.wanted GROUP BY 1""", uses=("sheet",))
def values_in_domain(spark, sf):
    customer, part = table(spark, sf, "customer"), table(spark, sf, "part")
    spaced = customer.select(F.expr("concat(substr(c_mktsegment, 1, 4), ' ', lower(substr(c_mktsegment, 5)))").alias("wanted"))
    wanted = spaced.union(part.select("p_type")).union(customer.select(F.upper("c_mktsegment")))
    cells = P.cells(view(spark, sf, "sheet"), F.col("id"), ["segment"])
    return M.values_in_domain(wanted, "wanted", cells).withColumn("samples", F.array_join("samples", "|"))


HOLDERS = ("segment", "gender", "balance_text", "active_text", "email")


@query("m10_columns_holding_values", f"""
WITH req AS (SELECT DISTINCT c_nationkey AS request, {k_sql('v')} AS k FROM (SELECT c_nationkey, c_mktsegment AS v FROM customer UNION ALL SELECT c_nationkey, CASE WHEN c_custkey % 40 = 0 THEN 'Fe-male' ELSE 'none' END FROM customer)),
cells AS (SELECT DISTINCT "column", {k_sql('v')} AS k FROM ({' UNION ALL '.join(f"SELECT '{c}' AS {chr(34)}column{chr(34)}, {c} AS v FROM sheet WHERE {c} IS NOT NULL" for c in HOLDERS)}) WHERE {k_sql('v')} <> ''),
s AS (SELECT request, "column", count(*) AS matches, (SELECT count(*) FROM req q WHERE q.request = r.request) AS requested FROM req r JOIN cells USING (k) GROUP BY 1, 2)
SELECT cast(request AS INTEGER) AS request, "column", matches, requested, matches / requested AS coverage, round(least(0.7, matches / requested * 0.7) + 0.1, 9) AS score FROM s""", uses=("sheet",))
def columns_holding(spark, sf):
    customer = table(spark, sf, "customer")
    asked = customer.select(F.col("c_nationkey").alias("request"), F.explode(F.array(
        F.col("c_mktsegment"), F.when(F.col("c_custkey") % 40 == 0, "Fe-male").otherwise("none"))).alias("value"))
    counts = P.value_counts(view(spark, sf, "sheet"), F.col("id"), list(HOLDERS))
    out = M.columns_holding(asked, "request", "value", counts, F.lit(0.1))  # text columns asked with a list of values
    return out.withColumn("score", F.round("score", 9))


CLAUSE = """CASE l_partkey % 7 WHEN 0 THEN 'paypal' WHEN 1 THEN 'completed' WHEN 2 THEN '2024-01-05' WHEN 3 THEN '42' WHEN 4 THEN 'laptop electronics' WHEN 5 THEN 'ref key' ELSE NULL END"""
FIELD = """CASE l_suppkey % 5 WHEN 0 THEN 'payment' WHEN 1 THEN 'order date' WHEN 2 THEN '' WHEN 3 THEN 'product name' ELSE 'status' END"""
OPERATOR = "CASE l_linenumber % 3 WHEN 0 THEN 'eq' WHEN 1 THEN 'gt' ELSE 'in' END"


def has_any(words, hints):
    return f"list_has_any({words}, {list(hints)!r})"


def concept_flags(v):
    w = f"string_split(trim(regexp_replace(lower({v}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    digits = f"regexp_matches({k_sql(v)}, '^[0-9]+$')"
    return {"payment": f"coalesce({has_any(w, M.PAYMENT_WORDS)}, false)", "status": f"coalesce({has_any(w, M.STATUS_WORDS)}, false)",
            "identifier": f"coalesce({has_any(w, M.IDENTIFIER_WORDS)} OR contains({v}, '@'), false)", "digits": f"coalesce({digits}, false)",
            "date": rf"coalesce(regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}$'), false)", "text": f"coalesce({k_sql(v)} <> '' AND NOT {digits}, false)"}


FLAGS = concept_flags("value")
CLAUSE_SQL = f"""
WITH {ENTRY_SQL}, req AS (SELECT {FIELD} AS field, {OPERATOR} AS operator, {CLAUSE} AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
q AS (SELECT *, {', '.join(f'{e} AS is_{k}' for k, e in FLAGS.items() if k != 'digits')}, {FLAGS['digits']} OR (value IS NULL AND operator = 'gt') AS is_numeric,
  list_filter(string_split(trim(regexp_replace(lower(field), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS asked,
  coalesce(string_split(trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')), ' '), []) AS vwords FROM req),
s AS (SELECT field, operator, value, n, ordinal, "column", round(greatest(0, least(1,
  CASE WHEN list_has_any(asked, tags) THEN 0.5 ELSE 0 END + CASE WHEN list_has_any(vwords, tags) THEN 0.25 ELSE 0 END
  + CASE broad_type WHEN 'product' THEN is_text::INT * 0.35 - (is_payment OR is_status)::INT * 0.45 WHEN 'payment' THEN is_payment::INT * 0.55 - (is_text AND NOT is_payment)::INT * 0.45
     WHEN 'status' THEN is_status::INT * 0.60 - (is_text AND NOT is_status)::INT * 0.35 WHEN 'identifier' THEN (is_identifier OR is_numeric)::INT * 0.4 - (is_text AND NOT is_identifier)::INT * 0.25
     WHEN 'date' THEN is_date::INT * 0.45 - (is_text AND NOT is_date)::INT * 0.25 WHEN 'currency' THEN is_numeric::INT * 0.35
     WHEN 'categorical' THEN is_text::INT * 0.15 + is_status::INT * 0.45 + is_payment::INT * 0.40 ELSE 0 END
  + CASE WHEN broad_type IN ('product', 'payment', 'status', 'identifier') THEN 0.2 WHEN broad_type = 'free_text' THEN 0.12 WHEN broad_type = 'categorical' THEN 0.18 ELSE 0 END
  + CASE WHEN operator IN ('eq', 'in') THEN 0.05 ELSE 0 END + CASE WHEN len(asked) = 0 AND is_text AND broad_type IN ('product', 'free_text') THEN 0.15 ELSE 0 END
  + match_score * 0.2)), 9)::DOUBLE AS score FROM q, cat),
r AS (SELECT *, row_number() OVER (PARTITION BY field, operator, value ORDER BY score DESC, ordinal) AS rank FROM s)"""


def clauses(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.expr(FIELD).alias("field"), F.expr(OPERATOR).alias("operator"), F.expr(CLAUSE).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def scored_clauses(spark, sf, k):
    about = clauses(spark, sf).withColumn("q", M.clause_features(F.col("field"), F.col("operator"), F.col("value")))
    return M.top_columns(about, ["field", "operator", "value", "n"], entries(spark), lambda c: F.round(M.clause_score(F.col("q"), c), 9), k=k)


@query("m11_clause_scores", CLAUSE_SQL + '\nSELECT field, operator, value, n, rank::INTEGER AS rank, "column", score FROM r WHERE rank <= 2')
def clause_scores(spark, sf):
    return scored_clauses(spark, sf, 2)


@query("m12_decisions", """
WITH r AS (SELECT l_orderkey, l_partkey, l_quantity / 50 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50 DESC, l_partkey) AS rn FROM lineitem),
t AS (SELECT l_orderkey, max(l_partkey) FILTER (rn = 1) AS leader, round(max(score) FILTER (rn = 1) - coalesce(max(score) FILTER (rn = 2), 0), 6) AS margin FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND margin <= 0.1 THEN 'clarify' WHEN l_orderkey % 3 <> 0 AND margin > 0.1 THEN 'resolve' ELSE 'clarify' END AS decision,
  CASE l_orderkey % 4 WHEN 0 THEN l_orderkey % 2 = 0 WHEN 1 THEN true WHEN 2 THEN true ELSE true END AS operator_ok, l_orderkey % 4 <> 1 AS shape_ok, l_orderkey % 7 <> 6 OR l_orderkey % 2 = 1 AS type_ok FROM t""")
def decisions(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") / 50).alias("score"))
    top = leader_rows(lines, "l_orderkey", ["l_partkey"], "score", 0.1)
    k = F.col("l_orderkey")
    chosen = F.when(k % 3 != 0, F.col("leader")).otherwise("another")
    operator = F.when(k % 4 == 0, ">").when(k % 4 == 1, "in").when(k % 4 == 2, "==").otherwise("is_null")
    kind = F.when(k % 2 == 0, "number").otherwise("text")
    value = F.when(k % 7 == 6, "abc").otherwise("12.5")
    op_ok, shape_ok, type_ok = M.gates(operator, value, F.lit(False), kind)
    return top.select("l_orderkey", M.decision(F.col("leader"), F.col("margin"), chosen, k % 5 == 0).alias("decision"),
                      op_ok.alias("operator_ok"), shape_ok.alias("shape_ok"), type_ok.alias("type_ok"))


V13 = "CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN cast(event_id AS string) WHEN 2 THEN 'a@b.org' WHEN 3 THEN concat('paid by ', event_type) WHEN 4 THEN '2024-02-01' ELSE 'card txn' END"


def concept_list(v):
    f = concept_flags(v)
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {f[k]} THEN '{n}' END" for k, n in (("date", "date"), ("identifier", "identifier"), ("digits", "numeric"), ("payment", "payment"), ("status", "status"), ("text", "text"))) + "], lambda x: x IS NOT NULL), '|')"


@query("m13_value_concepts", f"SELECT value, n, {concept_list('value')} AS concepts FROM (SELECT {V13} AS value, count(*) AS n FROM events GROUP BY 1)")
def literal_concepts(spark, sf):
    values = table(spark, sf, "events").groupBy(F.expr(V13).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.withColumn("concepts", F.array_join(M.value_concepts(F.col("value")), "|"))


@query("m14_first_columns", f"""
WITH {ENTRY_SQL}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1)
SELECT word, n, (SELECT "column" FROM cat WHERE len(list_filter("values", lambda v: contains(lower(v), lower(word)))) > 0 ORDER BY ordinal LIMIT 1) AS holder, 'order_date' AS date_column, 'unit_price' AS revenue_column FROM w""")
def first_columns(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("cat", M.as_value(entries(spark)))
    cat = F.col("cat")
    return words.select("word", "n", M.first_column(cat, M.holds_value(F.col("word"))).alias("holder"),
                        M.first_column(cat, M.name_has(M.DATE_PARTS)).alias("date_column"), M.first_column(cat, M.name_has(M.REVENUE_PARTS)).alias("revenue_column"))


ROOT = "CASE l_partkey % 6 WHEN 0 THEN 'vouchers' WHEN 1 THEN 'Debit' WHEN 2 THEN 'user ids' WHEN 3 THEN 'payments' WHEN 4 THEN 'files' ELSE 'nothing' END"


@query("m15_column_family", f"""
WITH {CAT_SQL}, r AS (SELECT requested, n, replace(regexp_replace(trim(regexp_replace(lower(requested), '[^a-z0-9]+', ' ', 'g')), 's$', ''), ' ', '_') AS root FROM (SELECT {ROOT} AS requested, count(*) AS n FROM lineitem GROUP BY 1))
SELECT requested, n, coalesce(array_to_string(list("column" ORDER BY ordinal) FILTER (starts_with(replace(trim(regexp_replace(lower("column"), '[^a-z0-9]+', ' ', 'g')), ' ', '_'), root)), '|'), '') AS family FROM r, cat GROUP BY requested, n""")
def column_family(spark, sf):
    asked = table(spark, sf, "lineitem").groupBy(F.expr(ROOT).alias("requested")).agg(F.count(F.lit(1)).alias("n"))
    cat = M.name_catalogue(spark, CATALOGUE).select("ordinal", "column", M.flat_words(F.col("column")).alias("flat_words"))
    held = asked.withColumn("cat", M.as_value(cat))
    return held.select("requested", "n", F.array_join(M.family(F.col("requested"), F.col("cat")), "|").alias("family"))


def low_sql(c):
    return f"replace(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ', '_')"


@query("m16_described_column", f"""
WITH {REQ_SQL}, {CAT_SQL}, d AS (SELECT requested, n, {low_sql('requested')} AS t FROM req), c AS (SELECT ordinal, "column", {low_sql('"column"')} AS m FROM cat)
SELECT requested, n, coalesce((SELECT "column" FROM c WHERE m = t ORDER BY ordinal LIMIT 1), (SELECT "column" FROM c WHERE contains(t, m) OR contains(m, t) ORDER BY ordinal LIMIT 1),
  (SELECT "column" FROM c WHERE list_has_any(list_filter(string_split(t, '_'), lambda w: length(w) > 2), string_split(m, '_')) ORDER BY ordinal LIMIT 1)) AS "column" FROM d""")
def described(spark, sf):
    cat = M.name_catalogue(spark, CATALOGUE).select("ordinal", "column", M.flat_words(F.col("column")).alias("flat_words"))
    asked = requests(spark, sf).withColumn("text", M.flat_words(F.col("requested"))).withColumn("cat", M.as_value(cat))
    return asked.select("requested", "n", M.described_column(F.col("text"), M.long_words(F.col("text")), F.col("cat")).alias("column"))
