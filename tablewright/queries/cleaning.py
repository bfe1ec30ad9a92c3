"""Scalar cleaning, missing values, duplicates, safe conversion, operation chains (C, N, D, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators import clean as K
from tablewright.operators import kpi
from tablewright.operators import profile as P
from tablewright.plans import chain as U
from tablewright.plans.calculations import calculate, metrics_table
from tablewright.queries.base import query, table, view
from tablewright.queries.quality import NUM, STRIP, num

SHEET = ("sheet",)


def sheet(spark, sf, *cols):
    df = view(spark, sf, "sheet")
    return df.select(*cols) if cols else df


@query("c01_trim_whitespace", f"SELECT id, {STRIP.format('full_name')} AS full_name, {STRIP.format('segment')} AS segment FROM sheet", uses=SHEET)
def trim(spark, sf):
    return K.on_strings(sheet(spark, sf, "id", "full_name", "segment"), X.strip_ws)


TITLE = "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"


@query("c02_text_case", f"""
SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up, {TITLE} AS title, concat(upper(p_name[1]), lower(p_name[2:])) AS capital FROM part""")
def case(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", X.change_case(F.col("p_brand"), "lower").alias("low"), X.change_case(n, "upper").alias("up"),
                                           X.change_case(n, "title").alias("title"), X.change_case(n, "capitalize").alias("capital"))


@query("c03_replace_values", "SELECT id, CASE gender WHEN 'M' THEN 'male' WHEN 'Others' THEN 'other' ELSE gender END AS gender FROM sheet", uses=SHEET)
def replace(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "gender"), lambda c: X.replace_values(c, {"M": "male", "Others": "other"}), ["gender"])


@query("c04_strip_currency", "SELECT id, regexp_replace(balance_text, '[$£€¥]', '', 'g') AS balance_text FROM sheet", uses=SHEET)
def currency_signs(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "balance_text"), X.strip_currency, ["balance_text"])


@query("c05_remove_commas", "SELECT id, replace(quantity_text, ',', '') AS quantity_text FROM sheet", uses=SHEET)
def commas(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "quantity_text"), X.remove_commas, ["quantity_text"])


@query("c06_normalize_currency", r"SELECT id, try_cast(regexp_replace(balance_text, '[^0-9.\-]', '', 'g') AS double) AS balance_text FROM sheet", uses=SHEET)
def normalize_currency(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "balance_text"), V.currency_number, ["balance_text"])


@query("c07_normalize_number", "SELECT id, try_cast(replace(quantity_text, ',', '') AS double) AS quantity_text FROM sheet", uses=SHEET)
def normalize_number(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "quantity_text"), V.plain_number, ["quantity_text"])


ISO = r"CASE WHEN regexp_matches(joined_text, '^\d{4}-\d{2}-\d{2}$') THEN joined_text END"
SLASH = r"CASE WHEN regexp_matches(joined_text, '^\d{1,2}/\d{1,2}/\d{4}$') THEN joined_text END"
DAYFIRST = f"coalesce(try_strptime({ISO}, '%Y-%m-%d'), try_strptime({SLASH}, '%d/%m/%Y'), try_strptime({SLASH}, '%m/%d/%Y'))"
MONTHFIRST = f"coalesce(try_strptime({ISO}, '%Y-%m-%d'), try_strptime({SLASH}, '%m/%d/%Y'), try_strptime({SLASH}, '%d/%m/%Y'))"


@query("c08_normalize_date", f"SELECT id, strftime({DAYFIRST}, '%d.%m.%Y') AS joined_text FROM sheet", uses=SHEET)
def normalize_date(spark, sf):
    return K.on_columns(sheet(spark, sf, "id", "joined_text"), lambda c: V.normalize_date(c, "%d.%m.%Y", dayfirst=True), ["joined_text"])


@query("c09_coerce_types", f"""
SELECT id, CASE active_text WHEN 'yes' THEN true WHEN 'true' THEN true WHEN 'no' THEN false END AS flag,
  {num('balance_text')} AS as_float, cast(cast({num('balance_text')} AS decimal(18,2)) AS double) AS as_decimal,
  CASE WHEN {num('balance_text')} = floor({num('balance_text')}) THEN cast({num('balance_text')} AS BIGINT) END AS as_integer,
  cast(nation AS string) AS as_string, strftime({MONTHFIRST}, '%Y-%m-%d') AS as_date
FROM sheet""", uses=SHEET)
def coerce(spark, sf):
    b = F.col("balance_text")
    return sheet(spark, sf).select(
        "id", V.coerce_type(F.col("active_text"), "boolean").alias("flag"), V.coerce_type(b, "float").alias("as_float"),
        V.coerce_type(b, "decimal").cast("double").alias("as_decimal"), V.coerce_type(b, "integer").alias("as_integer"),
        V.coerce_type(F.col("nation"), "string").alias("as_string"), F.date_format(V.coerce_type(F.col("joined_text"), "date"), "yyyy-MM-dd").alias("as_date"))


SEG = STRIP.format("segment")


@query("c10_normalize_categories", f"""
SELECT id, full_name, CASE lower({STRIP.format('gender')}) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'others' THEN 'Other' END AS gender,
  concat(upper(({SEG})[1]), lower(({SEG})[2:])) AS segment FROM (SELECT id, full_name, gender, segment FROM sheet) WHERE segment IS NOT NULL
UNION ALL SELECT id, full_name, CASE lower({STRIP.format('gender')}) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'others' THEN 'Other' END, NULL
FROM sheet WHERE segment IS NULL""", uses=SHEET)
def categories(spark, sf):
    return K.normalize_categories(sheet(spark, sf, "id", "full_name", "gender", "segment"))


@query("c11_word_form", "SELECT p_partkey, trim(regexp_replace(lower(concat(p_brand, '--', p_name)), '[^a-z0-9]+', ' ', 'g')) AS words FROM part")
def words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.word_form(F.concat("p_brand", F.lit("--"), "p_name")).alias("words"))


@query("c12_compact_form", "SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') AS compact FROM orders")
def compact(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.compact_form(F.col("o_orderpriority")).alias("compact"))


RAW_NAME = "concat('partXML', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), 'Id_', p_name)"


@query("c13_name_tokens", rf"""
SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({RAW_NAME}, '([a-z])([A-Z])', '\1 \2', 'g'),
  '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[_\s]+'), lambda t: t <> ''), '|') AS tokens FROM part""")
def tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.name_tokens(F.expr(RAW_NAME)), "|").alias("tokens"))


LKEY = "voucher_id, line_no, part_id, supp_id"


@query("c14_entry_parts", rf"""
SELECT {LKEY}, CASE WHEN regexp_matches(trim(entry_no), '^\d+\.\d+$') THEN cast(string_split(trim(entry_no), '.')[1] AS INTEGER) END AS entry_group,
  CASE WHEN regexp_matches(trim(entry_no), '^\d+\.\d+$') THEN cast(string_split(trim(entry_no), '.')[2] AS INTEGER) END AS entry_line FROM ledger""", uses=("ledger",))
def entry_parts(spark, sf):
    group, line = V.entry_parts(F.col("entry_no"))
    return view(spark, sf, "ledger").select(*LKEY.split(", "), group.alias("entry_group"), line.alias("entry_line"))


@query("c15_positive_amounts", f"""
SELECT {LKEY}, CASE WHEN {num('debit_amount')} > 0 THEN {num('debit_amount')} END AS debit,
  CASE WHEN {num('credit_amount')} > 0 THEN {num('credit_amount')} END AS credit FROM ledger""", uses=("ledger",))
def amounts(spark, sf):
    return view(spark, sf, "ledger").select(*LKEY.split(", "), V.positive_amount(F.col("debit_amount")).alias("debit"),
                                            V.positive_amount(F.col("credit_amount")).alias("credit"))


def masked(c):
    d = f"regexp_replace({c}, '[^0-9]+', '', 'g')"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN instr({c}, '@') = 1 THEN '<redacted>' WHEN instr({c}, '@') > 1 THEN concat(left({c}, 1), '***', substr({c}, instr({c}, '@'))) "
            f"WHEN length({d}) >= 6 THEN concat('****', right({d}, 4)) WHEN length({c}) <= 12 THEN '<redacted>' ELSE concat(left({c}, 2), '***', right({c}, 2)) END")


@query("c16_mask_values", f"SELECT id, {masked('email')} AS email, {masked('full_name')} AS account_name, {masked('segment')} AS card_type FROM sheet", uses=SHEET)
def mask(spark, sf):
    return sheet(spark, sf).select("id", X.mask_text(F.col("email")).alias("email"), X.mask_text(F.col("full_name")).alias("account_name"),
                                   X.mask_text(F.col("segment")).alias("card_type"))


@query("c16_mask_texts", rf"""
SELECT doc_id, left(regexp_replace({masked('text')}, '[\x00-\x08\x0B-\x1F]', '', 'g'), 64) AS masked, left(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), 64) AS shown
FROM documents""")
def mask_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.sample_text(t, True).alias("masked"), X.sample_text(t, False).alias("shown"))


ODD = "CASE event_id % 10 WHEN 0 THEN cast('NaN' AS double) WHEN 1 THEN cast('Infinity' AS double) WHEN 2 THEN cast('-Infinity' AS double) ELSE value END"


@query("c17_json_safe", f"""
SELECT event_id, CASE WHEN event_id % 10 > 2 THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events""")
def json_safe(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.expr(ODD)).select("event_id", "value", "ts")
    return df.select(*[V.json_safe(F.col(c), t).alias(c) for c, t in df.dtypes])


@query("c18_record_hash", "SELECT p_partkey, sha256(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size})::VARCHAR) AS digest FROM part")
def record_hash(spark, sf):
    df = table(spark, sf, "part").select("p_size", "p_name", "p_brand", "p_partkey")
    return df.select("p_partkey", V.record_hash(df.columns, volatile=("p_partkey",)).alias("digest"))


GIVEN = "CASE event_id % 3 WHEN 0 THEN concat(' ', cast(event_id AS string)) WHEN 1 THEN '  ' END"


@query("c19_event_key", f"""
SELECT event_id, coalesce(nullif(trim({GIVEN}), ''), concat('callback:', cast(user_id AS string), ':', sha256(props))) AS key FROM events""")
def event_key(spark, sf):
    return table(spark, sf, "events").select("event_id", V.event_key(F.expr(GIVEN), F.col("user_id"), F.col("props")).alias("key"))


STATUS_SQL = """CASE status WHEN 'pending' THEN 'queued' WHEN 'processing' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'success' THEN 'succeeded'
  WHEN 'partial' THEN 'failed' WHEN 'rejected' THEN 'quarantined' ELSE status END"""


@query("c20_status_alias", f"""
SELECT id, s AS status, CASE WHEN s IN ('failed', 'callback_failed') THEN 'invalid' WHEN s IN ('running', 'awaiting_schema_approval') THEN 'pending' ELSE 'valid' END AS verdict
FROM (SELECT id, {STATUS_SQL} AS s FROM jobs)""", uses=("jobs",))
def status_alias(spark, sf):
    s = F.col("status")
    return view(spark, sf, "jobs").select("id", kpi.normalized_status(s).alias("status"), kpi.validity(s).alias("verdict"))


@query("c21_display_id", """
SELECT doc_id, concat('FF-', lpad(cast(doc_id AS string), greatest(5, length(cast(doc_id AS string)))::INTEGER, '0')) AS shown_id,
  concat(left(text, 72), CASE WHEN length(text) > 72 THEN '...' ELSE '' END) AS title FROM documents""")
def display_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.display_id(F.col("doc_id")).alias("shown_id"), X.short_title(F.col("text")).alias("title"))


@query("c22_first_text", rf"""
SELECT id, CASE WHEN {SEG} <> '' THEN segment WHEN {STRIP.format('balance_text')} <> '' THEN balance_text ELSE '-' END AS first_text,
  regexp_replace({STRIP.format("regexp_replace(concat(full_name, '  of ', gender, ' . '), '[[:space:]]+', ' ', 'g')")}, '\.$', '') AS line FROM sheet""", uses=SHEET)
def first_text(spark, sf):
    raw = F.concat("full_name", F.lit("  of "), "gender", F.lit(" . "))
    return sheet(spark, sf).select("id", X.first_text(F.col("segment"), F.col("balance_text")).alias("first_text"), X.summary_line(raw).alias("line"))


@query("c23_merge_maps", """
SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('k=', props, ',') END, 'n=', cast(user_id AS string), ',note=old,status=', event_type) AS merged FROM events""")
def merge_maps(spark, sf):
    old = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("status"), F.lit("old"), F.lit("note"), F.lit("old"))).otherwise(
        F.create_map(F.lit("k"), F.col("props"), F.lit("status"), F.lit("old"), F.lit("note"), F.lit("old")))
    new = F.create_map(F.lit("status"), F.col("event_type"), F.lit("k"), F.lit("new"), F.lit("n"), F.col("user_id").cast("string"))
    merged = V.merge_json_maps(old, new, ("k",))
    pairs = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf, "events").select("event_id", F.array_join(pairs, ",").alias("merged"))


@query("c24_clock_text", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') AS shown FROM events")
def clock(spark, sf):
    return table(spark, sf, "events").select("event_id", X.clock_text(F.col("ts"), "Asia/Kolkata").alias("shown"))


LITERAL = "CASE event_id % 4 WHEN 0 THEN concat(cast(event_id AS string), '.0') WHEN 1 THEN concat(' ', cast(event_id AS string), '.5') WHEN 2 THEN ' abc ' ELSE cast(event_id AS string) END"


@query("c25_literal_text", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(event_id AS string) ELSE trim({LITERAL}) END AS for_number, trim({LITERAL}) AS for_text,
  concat(cast(event_id AS string), ',', event_type) AS listed FROM events""")
def literal(spark, sf):
    raw = F.expr(LITERAL)
    both = F.array(F.concat(F.col("event_id").cast("string"), F.lit(".0")), F.concat(F.lit(" "), "event_type"))
    return table(spark, sf, "events").select(
        "event_id", X.literal_text(raw, True).alias("for_number"), X.literal_text(raw, False).alias("for_text"),
        F.array_join(F.transform(both, lambda x: X.literal_text(x, True)), ",").alias("listed"))


SECS = "datediff('second', ts, TIMESTAMP '2024-02-01')"
MINS = f"greatest(1, floor({SECS} / 60.0 + 0.5))"


@query("c26_age_label", f"""
SELECT event_id, CASE WHEN m < 60 THEN concat('Last run ', m::BIGINT, ' min ago') WHEN floor(m / 60 + 0.5) < 24 THEN concat('Last run ', floor(m / 60 + 0.5)::BIGINT, ' hr ago')
  ELSE concat('Last run ', floor(floor(m / 60 + 0.5) / 24 + 0.5)::BIGINT, ' day ago') END AS label
FROM (SELECT event_id, greatest(1, floor(floor(epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 60.0 + 0.5)) AS m FROM events)""")
def age(spark, sf):
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", X.age_label(seconds).alias("label"))


# -- missing values ---------------------------------------------------------------------------------------------

@query("n01_fill_constant", "SELECT id, coalesce(visits, 0) AS visits, coalesce(segment, '') AS segment, coalesce(email, 'none') AS email FROM sheet", uses=SHEET)
def fill_constant(spark, sf):
    df = sheet(spark, sf, "id", "visits", "segment", "email")
    return df.transform(K.fill_nulls, ["visits"], "zero").transform(K.fill_nulls, ["segment"], "empty_string").transform(K.fill_nulls, ["email"], "constant", "none")


@query("n02_fill_mean", "SELECT id, round(coalesce(balance, (SELECT avg(balance) FROM sheet)), 6) AS balance FROM sheet", uses=SHEET)
def fill_mean(spark, sf):
    return K.fill_nulls(sheet(spark, sf, "id", "balance"), ["balance"], "mean").select("id", F.round("balance", 6).alias("balance"))


@query("n03_fill_median", "SELECT id, coalesce(balance, (SELECT median(balance) FROM sheet)) AS balance FROM sheet", uses=SHEET)
def fill_median(spark, sf):
    return K.fill_nulls(sheet(spark, sf, "id", "balance"), ["balance"], "median")


@query("n04_fill_mode", """
SELECT id, coalesce(segment, (SELECT segment FROM sheet WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment,
  coalesce(visits, (SELECT visits FROM sheet WHERE visits IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, visits LIMIT 1)) AS visits FROM sheet""", uses=SHEET)
def fill_mode(spark, sf):
    return K.fill_nulls(sheet(spark, sf, "id", "segment", "visits"), ["segment", "visits"], "mode")


@query("n05_drop_empty_rows", "SELECT segment, balance_text, visits FROM sheet WHERE segment IS NOT NULL OR balance_text IS NOT NULL OR visits IS NOT NULL", uses=SHEET)
def empty_rows(spark, sf):
    return K.drop_empty_rows(sheet(spark, sf, "segment", "balance_text", "visits"))


@query("n06_drop_nulls", f"SELECT id, segment, email FROM sheet WHERE {SEG} <> '' AND email IS NOT NULL", uses=SHEET)
def drop_nulls(spark, sf):
    return K.drop_nulls(sheet(spark, sf, "id", "segment", "email"), ["segment", "email"], "any")


@query("n07_blanks_to_null", f"SELECT id, CASE WHEN {SEG} <> '' THEN segment END AS segment FROM sheet", uses=SHEET)
def blanks(spark, sf):
    return K.blanks_to_null(sheet(spark, sf, "id", "segment"))


# -- duplicates -------------------------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def dedup(name, keep, direction):
    order = ", ".join(f"{c} {direction}" for c in LINE[2:])

    @query(name, f"""SELECT {', '.join(LINE)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1""")
    def run(spark, sf):
        return K.drop_duplicates(table(spark, sf, "lineitem").select(*LINE), ["l_orderkey", "l_linenumber", "absent"], keep, ["l_partkey", "l_suppkey"])


dedup("d01_keep_first", "first", "ASC")
dedup("d02_keep_last", "last", "DESC")


@query("d01_whole_rows", "SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 3 = 0)")
def whole_rows(spark, sf):
    lines = table(spark, sf, "lineitem")
    return K.drop_duplicates(lines.union(lines.where("l_orderkey % 3 = 0")))


@query("d03_keep_none", f"SELECT {', '.join(LINE)} FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def keep_none(spark, sf):
    return K.drop_duplicates(table(spark, sf, "lineitem").select(*LINE), ["l_orderkey", "l_linenumber"], False)


@query("d04_duplicate_count", "SELECT cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 3 = 0) AS BIGINT) AS duplicate_rows FROM lineitem")
def duplicate_count(spark, sf):
    lines = table(spark, sf, "lineitem")
    return K.duplicate_count(lines.union(lines.where("l_orderkey % 3 = 0")))


@query("d05_union_tables", """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""")
def union_tables(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit(1).alias("Unnamed: 3"))
    return K.union_tables(a, b)


@query("d06_ordered_distinct", "SELECT p_name, min(p_partkey) AS first_seen FROM part GROUP BY 1")
def ordered_distinct(spark, sf):
    return K.ordered_distinct(table(spark, sf, "part"), "p_name", "p_partkey")


# -- safe conversions ---------------------------------------------------------------------------------------------

@query("t01_safe_numeric", f"""
SELECT {LKEY}, voucher_date, account_code, {num('entry_no')} AS entry_no, {num('debit_amount')} AS debit_amount, {num('credit_amount')} AS credit_amount FROM ledger""",
       uses=("ledger",))
def safe_numeric(spark, sf):
    return K.safe_convert(view(spark, sf, "ledger"), "numeric")


MONEY_TEXT = r"trim(replace(regexp_replace(balance_text, '(?i)[$€£¥]|\bUSD\b', '', 'g'), ',', ''))"
MONEY = f"CASE WHEN regexp_matches({MONEY_TEXT}, {NUM}) THEN cast({MONEY_TEXT} AS double) END"


@query("t02_safe_currency", f"SELECT id, gender, {MONEY} AS balance_text FROM sheet", uses=SHEET)
def safe_currency(spark, sf):
    return K.safe_convert(sheet(spark, sf, "id", "gender", "balance_text"), "currency")


@query("t03_safe_date", f"SELECT id, gender, strftime({MONTHFIRST}, '%Y-%m-%d') AS joined FROM sheet", uses=SHEET)
def safe_date(spark, sf):
    out = K.safe_convert(sheet(spark, sf, "id", "gender", "joined_text"), "date")
    return out.select("id", "gender", F.date_format("joined_text", "yyyy-MM-dd").alias("joined"))


@query("t04_lower_strings", f"SELECT id, lower({SEG}) AS segment, lower({STRIP.format('gender')}) AS gender FROM sheet", uses=SHEET)
def lower_strings(spark, sf):
    return K.lower_strings(sheet(spark, sf, "id", "segment", "gender"))


def low(c):
    return f"lower(nullif({STRIP.format(c)}, ''))"


@query("t05_prepare_for_filter", f"""
SELECT id, {low('full_name')} AS full_name, {low('segment')} AS segment, {MONEY} AS balance_text, try_cast(replace(quantity_text, ',', '') AS double) AS quantity_text,
  strftime({MONTHFIRST}, '%Y-%m-%d') AS joined_text, balance, {low('gender')} AS gender, {low('email')} AS email, {low('active_text')} AS active_text, nation, visits, notes
FROM sheet""", uses=SHEET)
def prepare(spark, sf):
    return K.prepare_for_filter(sheet(spark, sf)).withColumn("joined_text", F.date_format("joined_text", "yyyy-MM-dd"))


def detected(expr_of):
    cols = ("full_name", "joined_text", "entry_like", "iso_text", "notes")
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {expr_of(c)} AS type FROM typed" for c in cols)


def typed(spark, sf):
    df = sheet(spark, sf, "full_name", "joined_text", "id", "notes")
    return df.select("full_name", "joined_text", F.concat(F.col("id").cast("string"), F.lit(".5")).alias("entry_like"),
                     F.when(F.col("joined_text") != "unknown", F.col("joined_text")).alias("iso_text"), "notes")


TYPED = """typed AS (SELECT full_name, joined_text, concat(cast(id AS string), '.5') AS entry_like, CASE WHEN joined_text <> 'unknown' THEN joined_text END AS iso_text, notes FROM sheet)"""


def share(c, kind):
    from tablewright.queries.quality import stamp

    parsed = stamp(c) if kind == "date" else num(c)
    return f"count({parsed}) / count({c})"


@query("t06_detected_types", f"""WITH {TYPED} {detected(lambda c: f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN {share(c, 'date')} >= 0.9 THEN 'date' WHEN {share(c, 'number')} >= 0.9 THEN 'number' ELSE 'string' END")}""", uses=SHEET)
def detected_types(spark, sf):
    return P.detected_types(typed(spark, sf), ("date", "number"))


@query("t07_display_types", f"""WITH {TYPED} {detected(lambda c: f"CASE WHEN count({c}) = 0 THEN 'string' WHEN {share(c, 'number')} >= 0.9 THEN 'number' WHEN {share(c, 'date')} >= 0.9 THEN 'date' ELSE 'string' END")}""", uses=SHEET)
def display_types(spark, sf):
    return P.detected_types(typed(spark, sf), ("number", "date"), dayfirst=True, empty="string")


@query("t08_lean_types", f"""WITH {TYPED} {detected(lambda c: f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN {share(c, 'number')} >= 0.9 THEN 'number' ELSE 'string' END")}""", uses=SHEET)
def lean_types(spark, sf):
    return P.detected_types(typed(spark, sf), ("number",))


# -- chains of operations -----------------------------------------------------------------------------------------

@query("u01_audited_chain", """
WITH c AS (SELECT count(*) AS n, count(email) AS k FROM sheet)
SELECT 0 AS step, 'trim_whitespace' AS operation, n AS rows_in, n AS rows_out, '' AS columns_changed, 'user_requested' AS step_kind FROM c
UNION ALL SELECT 1, 'normalize_currency', n, n, 'balance_text', 'user_requested' FROM c UNION ALL SELECT 2, 'fill_nulls', n, n, 'visits', 'user_requested' FROM c
UNION ALL SELECT 3, 'drop_nulls', n, k, 'email', 'user_requested' FROM c""", uses=SHEET)
def audited_chain(spark, sf):
    steps = [("trim_whitespace", {}), ("normalize_currency", {"columns": ["balance_text"]}), ("fill_nulls", {"columns": ["visits"], "strategy": "zero"}),
             ("drop_nulls", {"columns": ["email"]})]
    return U.run_chain(sheet(spark, sf), steps).audit().drop("duration_ms", "params_hash")


@query("u01_calculation_chain", """
WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT 'sum_all' AS name, (SELECT sum(l_quantity) FROM lineitem) AS value UNION ALL SELECT 'n', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'largest', (SELECT max(q) FROM g) UNION ALL SELECT 'middle', (SELECT median(q) FROM g)""")
def calculation_chain(spark, sf):
    """Scalars before the grouping see the rows, scalars after it see the groups."""
    ops = [{"type": "sum", "column": "l_quantity", "output_column": "sum_all"}, {"type": "count", "column": "l_quantity", "output_column": "n"},
           {"type": "group_sum", "group_by": ["l_returnflag", "l_linestatus"], "column": "l_quantity", "output_column": "q"},
           {"type": "max", "column": "q", "output_column": "largest"}, {"type": "median", "column": "q", "output_column": "middle"}]
    return metrics_table(calculate(table(spark, sf, "lineitem"), ops))


@query("u02_missing_columns", """
SELECT count(*) AS "rows", 'missing columns [''absent'']; the table has [''o_orderkey'', ''o_custkey'']' AS error FROM orders""")
def missing_columns(spark, sf):
    from tablewright.operators.columns import MissingColumns

    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    try:
        U.run_chain(df, [("drop_nulls", {"columns": ["absent"]})])
        found = "no error"
    except MissingColumns as e:
        found = str(e)
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("error", F.lit(found))


@query("u03_default_cleaning", f"""
SELECT DISTINCT {STRIP.format('full_name')} AS full_name, {STRIP.format('gender')} AS gender_code FROM sheet""", uses=SHEET)
def default_cleaning(spark, sf):
    return U.default_cleaning(sheet(spark, sf).select(F.col("full_name").alias("Full Name"), F.col("gender").alias("genderCode")))
