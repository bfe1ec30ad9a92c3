"""Table and column profiles as DataFrames with one row per column.

Counts of all columns come from one aggregation. Values (representative, frequent, rare) come from one
table of (column, value, count): cells are unpivoted and counted with map-side combine, so a value that
fills a third of a column is one row per task in the shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators.columns import is_numeric
from tablewright.operators.rows import first_per_key

SAMPLE_VALUES = 5
TASK_CELLS = 2_000_000  # cells whose values one task counts before the shuffle
LARGE_BYTES = 50_000_000

# Name parts behind the semantic guess of a column.
DATE_NAME_HINTS = ("date", "time", "timestamp", "dob", "birthday", "birth_date", "created", "modified", "updated", "_at")
CURRENCY_NAME_HINTS = ("price", "amount", "cost", "revenue", "total", "fee", "salary", "income", "balance", "currency", "usd", "eur", "gbp")
CATEGORY_NAME_HINTS = ("status", "state", "category", "type", "kind", "group", "class", "segment", "tier", "mode")
MONEY_SIGNS = "[$€£¥₹]"

# Tags behind the broad type of a column.
PRODUCT_TAGS = ("product", "item", "sku", "goods", "catalog", "catalogue", "material", "article", "title")
PAYMENT_TAGS = ("payment", "pay", "method", "mode", "tender", "merchant", "vendor", "seller", "payee", "wallet", "card", "cash", "upi", "bank")
STATUS_TAGS = ("status", "state", "stage", "progress", "outcome", "result", "flag", "approval")
IDENTIFIER_TAGS = ("id", "identifier", "uuid", "key", "code", "reference", "ref", "txn", "transaction")

# Business roles, the names that stand for them, and their canonical columns.
ROLE_HINTS = {
    "transaction_id": ("transaction_id", "txn_id", "tx_id", "transactionid", "order_id", "invoice_id", "id"),
    "merchant": ("merchant", "merchant_name", "vendor", "provider", "payment_method", "payment_type", "gateway"),
    "gender": ("gender", "sex"),
    "marital_status": ("marital_status", "maritalstatus", "relationship_status", "civil_status"),
    "education": ("education", "education_level", "degree", "qualification", "academic_qualification"),
    "quantity": ("quantity", "qty", "qty_ordered", "units", "pieces", "volume", "count"),
    "payment_value": ("payment", "payment_value", "amount", "amt", "price", "cost", "value", "total", "subtotal", "unit_price",
                      "debit_amount", "credit_amount"),
    "status": ("status", "transaction_status", "payment_status", "state"),
    "date": ("date", "transaction_date", "txn_date", "invoice_date", "posting_date", "voucher_date"),
}
ROLE_TARGETS = {
    "transaction_id": "transaction_id", "merchant": "merchant", "gender": "gender", "marital_status": "marital_status",
    "education": "education_level", "quantity": "quantity", "payment_value": "payment_value", "status": "status",
    "date": "transaction_date",
}


def _is_date(dtype: str) -> bool:
    return dtype.startswith(("timestamp", "date"))


def _plain(df: DataFrame) -> DataFrame:
    """Only columns with simple values; nested ones have no text form to profile."""
    return df.select(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))])


def _spread(df: DataFrame, width: int) -> DataFrame:
    """Rows dealt evenly over so many tasks that each counts about ``TASK_CELLS`` cells; a file read by one task would else be counted by one."""
    parts = math.ceil(df.count() * width / TASK_CELLS)
    return df.repartition(parts, F.monotonically_increasing_id()) if parts > 1 else df


def _value_key(c: Column, dtype: str) -> Column:
    """Text that is equal exactly where the values are: one zero, and moments by their number."""
    if dtype in ("float", "double"):
        c = c + F.lit(0).cast(dtype)
    elif dtype == "timestamp":
        c = F.unix_micros(c)
    return (F.collation_key(c) if dtype.startswith("string collate") else c).cast("string")


def _distinct_counts(flat: DataFrame) -> DataFrame:
    """(ordinal, distinct_count) of every column with a value. Only a column's number and a value are kept in memory and shuffled for each distinct cell."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), _value_key(F.col(f"`{c}`"), t).alias("value")) for i, (c, t) in enumerate(flat.dtypes)])
    found = _spread(flat, len(flat.columns)).select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    return found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))


def table_profile(df: DataFrame, size_bytes: int | None = None) -> DataFrame:
    """Rows, columns, duplicate rows and a warning for large tables; one grouping pass."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.lit(bool(size_bytes and size_bytes > LARGE_BYTES)).alias("large_table"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Null, non-null and distinct counts, number and date range, average text length per column.

    ``exact=False`` takes sketch-based distinct counts: no row expansion, one light pass for very wide tables.
    """
    flat = _plain(df)
    rows = F.count(F.lit(1))
    aggs, structs = [], []
    for i, (c, t) in enumerate(flat.dtypes):
        col = F.col(f"`{c}`")
        aggs += [rows.alias("_rows")] if not i else []
        aggs += [F.count(col).alias(f"n{i}")] + ([] if exact else [F.approx_count_distinct(col).alias(f"d{i}")])
        aggs += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")] if is_numeric(t) or _is_date(t) else []
        aggs += [F.avg(F.length(col)).alias(f"len{i}")] if t == "string" else []
        number, date, text = is_numeric(t), _is_date(t), t == "string"
        stamp = "yyyy-MM-dd'T'HH:mm:ss"
        structs.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
            (F.col("_rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"n{i}").alias("non_null_count"),
            (F.lit(0).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_count"),
            (F.col(f"lo{i}").cast("double") if number else F.lit(None).cast("double")).alias("numeric_min"),
            (F.col(f"hi{i}").cast("double") if number else F.lit(None).cast("double")).alias("numeric_max"),
            (F.date_format(F.col(f"lo{i}"), stamp) if date else F.lit(None).cast("string")).alias("date_min"),
            (F.date_format(F.col(f"hi{i}"), stamp) if date else F.lit(None).cast("string")).alias("date_max"),
            (F.col(f"len{i}") if text else F.lit(None).cast("double")).alias("average_text_length")))
    base = flat.agg(*aggs).select(F.inline(F.array(*structs)))
    if not exact:
        return base
    counted = _distinct_counts(flat).select(F.col("ordinal").alias("_ordinal"), F.col("distinct_count").alias("_distinct"))
    joined = base.join(F.broadcast(counted), F.col("ordinal") == F.col("_ordinal"), "left")  # one row per column on both sides
    return joined.withColumn("distinct_count", F.coalesce("_distinct", "distinct_count")).drop("_ordinal", "_distinct")


def cells(df: DataFrame, order: Column, cols: list[str] | None = None) -> DataFrame:
    """(column, value, first) for every non-null cell, values as text."""
    names = cols or _plain(df).columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    return df.select(order.alias("first"), F.explode(pairs).alias("c")).select("first", "c.*").where("value IS NOT NULL")


def value_counts(df: DataFrame, order: Column, cols: list[str] | None = None) -> DataFrame:
    """(column, value, n, first): how often each value occurs and where it appears first."""
    return cells(_spread(df, len(cols or _plain(df).columns)), order, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))


def sample_values(counts: DataFrame, kind: str, k: int = SAMPLE_VALUES, seed: int = 7) -> DataFrame:
    """(column, rank, value): k values per column, masked where the column name is sensitive.

    representative: first seen; frequent: most often, first seen among equals; rare: least often, by value;
    random: a repeatable shuffle by hash.
    """
    order = {
        "representative": [F.asc("first"), F.asc("value")],
        "frequent": [F.desc("n"), F.asc("first"), F.asc("value")],
        "rare": [F.asc("n"), F.asc("value")],
        "random": [F.asc(F.xxhash64(F.lit(seed), "column", "value")), F.asc("value")],
    }[kind]
    top = first_per_key(counts, ["column"], order, k, rank="rank")
    sensitive = F.lit(False)
    flat = F.regexp_replace(F.lower(F.trim("column")), "[^a-z0-9]+", "_")
    for hint in X.SENSITIVE_NAME_HINTS:
        sensitive = sensitive | F.contains(flat, F.lit(hint))
    shown = F.when(sensitive, X.sample_text(F.col("value"), True)).otherwise(X.sample_text(F.col("value"), False))
    return top.select("column", F.col("rank").cast("bigint").alias("rank"), shown.alias("value"))


def _has(c: Column, hints) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(h)) for h in hints])


def head_shares(df: DataFrame, order: Column | None = None, head: int | None = None) -> DataFrame:
    """(column, date_share, money_share) of each text column, over all its values in one aggregation.

    ``head`` limits the test to that many first values by ``order``.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    date, money = lambda c: V.to_timestamp(c).isNotNull().cast("int"), lambda c: c.rlike(MONEY_SIGNS).cast("int")
    if head is not None:
        heads = first_per_key(cells(df, order, texts), ["column"], [F.asc("first"), F.asc("value")], head)
        return heads.groupBy("column").agg(F.avg(date(F.col("value"))).alias("date_share"), F.avg(money(F.col("value"))).alias("money_share"))
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, date_share double, money_share double")
    cell = {i: F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")) for i, c in enumerate(texts)}
    aggs = [f(c).alias(f"{k}{i}") for i, c in cell.items() for k, f in (("d", lambda c: F.avg(F.when(c.isNotNull(), date(c)))), ("m", lambda c: F.avg(F.when(c.isNotNull(), money(c)))))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("date_share"), F.col(f"m{i}").alias("money_share")) for i, c in enumerate(texts)])
    return df.agg(*aggs).select(F.inline(rows)).where("date_share IS NOT NULL")


def semantic_guesses(profile: DataFrame, shares: DataFrame) -> DataFrame:
    """Profile with semantic_guess and confidence, from type, name hints and the first values."""
    p = profile.join(F.broadcast(shares), "column", "left")  # one row per column on both sides
    name, dtype = F.lower(F.trim("column")), F.col("dtype")
    text, number = dtype == "string", dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    date_share, money_share = F.coalesce("date_share", F.lit(0.0)), F.coalesce("money_share", F.lit(0.0))
    few = (F.col("distinct_count") <= 20) & (F.col("non_null_count") >= 5) & (F.col("distinct_count") <= F.col("non_null_count") * 0.5)
    cases = [
        (dtype == "boolean", "boolean", 1.0),
        (dtype.rlike("^(timestamp|date)"), "date", 1.0),
        (_has(name, DATE_NAME_HINTS) & text & (date_share >= 0.6), "date", 0.9),
        (_has(name, DATE_NAME_HINTS), "date", 0.7),
        (_has(name, CURRENCY_NAME_HINTS) & number, "currency", 0.9),
        (_has(name, CURRENCY_NAME_HINTS) & text & (money_share >= 0.5), "currency", 0.85),
        (_has(name, CURRENCY_NAME_HINTS), "currency", 0.7),
        (_has(name, CATEGORY_NAME_HINTS) & ~number, "categorical", 0.8),
        (text & (money_share >= 0.7), "currency", 0.8),
        (number, "numeric", 0.85),
        (text & (F.col("non_null_count") == 0), "string", 0.5),
        (text & few, "categorical", 0.75),
        (text, "string", 0.6),
    ]
    guess, sure = F.lit("unknown"), F.lit(0.0)
    for test, g, s in reversed(cases):
        guess, sure = F.when(test, F.lit(g)).otherwise(guess), F.when(test, F.lit(s)).otherwise(sure)
    return p.withColumns({"semantic_guess": guess, "confidence": sure}).drop("date_share", "money_share")


def _overlaps(tags: Column, hints) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(h) for h in hints]))


def broad_types(guessed: DataFrame) -> DataFrame:
    """Broad type and score from the guess and the tags in the column name."""
    tags = F.filter(F.split(X.word_form(F.col("column")), " "), lambda t: t != "")
    guess = F.col("semantic_guess")
    floor = F.greatest(F.lit(10), F.floor(F.greatest(F.col("non_null_count"), F.lit(1)) * 0.25))
    broad = (
        F.when((guess == "date") | F.array_contains(tags, "date"), "date")
        .when((guess == "currency") | F.array_contains(tags, "currency"), "currency")
        .when(guess == "numeric", "numeric")
        .when((guess == "boolean") | F.array_contains(tags, "boolean"), "boolean")
        .when(_overlaps(tags, PRODUCT_TAGS), "product").when(_overlaps(tags, PAYMENT_TAGS), "payment")
        .when(_overlaps(tags, STATUS_TAGS), "status").when(_overlaps(tags, IDENTIFIER_TAGS), "identifier")
        .when(F.coalesce(F.col("average_text_length") >= 18, F.lit(False)), "free_text")
        .when(F.col("distinct_count") <= floor, "categorical")
        .when(guess == "categorical", "categorical").when(guess == "string", "free_text").otherwise("unknown")
    )
    typed = guessed.withColumn("broad_type", broad)
    b = F.col("broad_type")
    tagged = b.isin("product", "payment", "status", "identifier")  # these types only arise from a tag
    base = (
        F.when(b.isin("date", "currency", "numeric", "boolean"), 0.95).when(tagged, 0.92)
        .when(b == "categorical", 0.75).when(b == "free_text", 0.7).otherwise(0.35)
    )
    return typed.withColumn("match_score", F.when(F.col("confidence") >= 0.9, F.greatest(base, F.lit(0.9))).otherwise(base))


def column_roles(guessed: DataFrame) -> DataFrame:
    """identifier / boolean / temporal / measure / categorical / dimension / text / unknown with a confidence."""
    guess, dtype = F.col("semantic_guess"), F.col("dtype")
    share = F.try_divide(F.col("distinct_count"), F.col("non_null_count"))
    filled = (F.col("non_null_count") > 0) & (F.col("distinct_count") > 0)
    cases = [
        (F.col("column").rlike("(?i)(^id$|^uuid$|_id$)"), "identifier", 0.9),
        (guess == "boolean", "boolean", 0.95),
        ((guess == "date") | dtype.rlike("^(timestamp|date)"), "temporal", 0.9),
        (guess.isin("numeric", "currency") | dtype.rlike("^(tinyint|smallint|int|bigint|float|double)"), "measure", 0.85),
        (guess == "categorical", "categorical", 0.8),
        (filled & (share <= 0.05) & (F.col("distinct_count") <= 20), "categorical", 0.75),
        (filled & (share <= 0.2) & (F.col("distinct_count") <= 50), "dimension", 0.7),
        ((guess == "string") & filled & (share > 0.5), "text", 0.7),
        (guess == "string", "text", 0.6),
    ]
    role, sure = F.lit("unknown"), F.lit(0.3)
    for test, r, s in reversed(cases):
        role, sure = F.when(test, F.lit(r)).otherwise(role), F.when(test, F.lit(s)).otherwise(sure)
    return guessed.withColumns({"role": role, "role_confidence": sure})


def business_role(name: Column) -> Column:
    """First business role whose hint equals the name or whose hint words all occur in it."""
    flat = F.regexp_replace(X.word_form(name), " ", "_")
    words = F.split(flat, "_")
    out = F.lit(None).cast("string")
    for role, hints in reversed(ROLE_HINTS.items()):
        fits = [F.size(F.array_except(F.array(*[F.lit(w) for w in h.split("_")]), words)) == 0 for h in hints]
        out = F.when(flat.isin(*hints) | reduce(lambda a, b: a | b, fits), F.lit(role)).otherwise(out)
    return out


def canonical_target(name: Column) -> Column:
    pairs = [F.lit(x) for kv in ROLE_TARGETS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), business_role(name))


def field_mapping(columns: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    """Proposed target per source column with confidence and reason."""
    c, target = F.col("column"), canonical_target(F.col("column"))
    known = c.isin(*aliases)
    return columns.select(
        "column",
        F.when(known, c).otherwise(F.coalesce(target, c)).alias("target"),
        F.when(known | target.isNotNull(), "high").otherwise("medium").alias("confidence"),
        F.when(known, "known name").when(target.isNotNull(), "name words").when(c == "raw_text", "kept text").otherwise("as is").alias("reason"))


def lean_profile(df: DataFrame, order: Column, samples: int = 3) -> DataFrame:
    """Nullable, null and distinct counts, first samples, range as numbers if any value is one, else as text."""
    flat = _plain(df)
    aggs, structs = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(flat.columns):
        t = F.col(f"`{c}`").cast("string")
        number = V.to_number(t)
        aggs += [F.count(t).alias(f"n{i}"), F.min(number).alias(f"lo{i}"),
                 F.max(number).alias(f"hi{i}"), F.min(t).alias(f"tlo{i}"), F.max(t).alias(f"thi{i}")]
        structs.append(F.struct(
            F.lit(c).alias("column"), (F.col(f"n{i}") < F.col("_rows")).alias("nullable"), (F.col("_rows") - F.col(f"n{i}")).alias("null_count"),
            F.col(f"lo{i}").alias("min_number"), F.col(f"hi{i}").alias("max_number"),
            F.when(F.col(f"lo{i}").isNull(), F.col(f"tlo{i}")).alias("min_text"), F.when(F.col(f"lo{i}").isNull(), F.col(f"thi{i}")).alias("max_text")))
    base = flat.agg(*aggs).select(F.inline(F.array(*structs)))
    counts = value_counts(df, order, flat.columns).where("value <> ''")
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    firsts = first_per_key(counts, ["column"], [F.asc("first"), F.asc("value")], samples, rank="_r")
    shown = firsts.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"]).alias("samples"))
    out = base.join(F.broadcast(distinct), "column", "left").join(shown, "column", "left")  # one row per column in all three
    return out.select("column", "nullable", "null_count", F.coalesce("_d", F.lit(0).cast("bigint")).alias("distinct_count"), "min_number", "max_number", "min_text", "max_text", "samples")


def result_fields(profile: DataFrame, rows: int | None = None) -> DataFrame:
    """Role of each result field: identifier by name, measure, time, category when few distinct values, else dimension."""
    low = F.lower(F.trim("column"))
    ident = low.rlike("(_id|_number|_key|_no)$") | low.startswith("id_") | low.isin("id", "index", "row_number", "record_id")
    total = F.col("null_count") + F.col("non_null_count")
    role = (
        F.when(ident, "identifier").when(F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), "measure")
        .when(F.col("dtype").rlike("^(timestamp|date)"), "time")
        .when((total > 0) & (F.col("distinct_count") < total * 0.5), "category").otherwise("dimension")
    )
    return profile.withColumn("field_role", role)


def detected_types(df: DataFrame, order: tuple[str, ...], share: float = 0.9, dayfirst: bool = False, empty: str = "empty") -> DataFrame:
    """(column, type): the first type in ``order`` that enough values parse as, else string; one scan."""
    flat = _plain(df)
    aggs, structs = [], []
    for i, (c, t) in enumerate(flat.dtypes):
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"n{i}"))
        if is_numeric(t) or _is_date(t):
            kind = F.lit("number" if is_numeric(t) else "date")
        else:
            text = col.cast("string")
            tests = {"date": V.to_timestamp(text, dayfirst).isNotNull(), "number": V.is_number(text)}
            kind = F.lit("string")
            for k in reversed(order):
                aggs.append(F.count_if(tests[k]).alias(f"{k}{i}"))
                kind = F.when(F.col(f"{k}{i}") >= F.col(f"n{i}") * share, F.lit(k)).otherwise(kind)
        structs.append(F.struct(F.lit(c).alias("column"), F.when(F.col(f"n{i}") == 0, F.lit(empty)).otherwise(kind).alias("type")))
    return flat.agg(*aggs).select(F.inline(F.array(*structs)))


def _digest(rows: DataFrame, *fields: str) -> DataFrame:
    """SHA-256 over rows in order; one row per column of the table, so the list stays small."""
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))), 256).alias("fingerprint"))


def structure_fingerprint(profile: DataFrame) -> DataFrame:
    """Hash of lower-case names, types and nullability."""
    rows = profile.select(F.lower("column").alias("name"), "dtype", (F.col("null_count") > 0).alias("nullable"))
    return _digest(rows, "name", "dtype", "nullable")


def profile_fingerprint(profile: DataFrame, frequent: DataFrame) -> DataFrame:
    """Hash of distinct counts and of the hashed frequent values."""
    tops = frequent.groupBy("column").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "value")))), 256).alias("tops"))
    rows = profile.join(tops, "column", "left").select(F.lower("column").alias("name"), "distinct_count", F.coalesce("tops", F.lit("")).alias("tops"))
    return _digest(rows, "name", "distinct_count", "tops")
