"""Small literal tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators import aggregate as A
from tablewright.operators import clean as K
from tablewright.operators import columns as C
from tablewright.operators import match as M
from tablewright.operators import profile as P
from tablewright.operators import quality as Q
from tablewright.operators.filters import Aggregate, Condition, filter_rows
from tablewright.plans import chain as U
from tablewright.sources import files as R


def one(spark, values, kind="string", name="c"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def column(df, c=None):
    return [r[0] for r in (df.select(c) if c is not None else df).collect()]


def test_trim_keeps_nulls(spark):
    df = one(spark, ["  John  ", None, "\tAlice\n"])
    assert column(df, X.strip_ws(F.col("c"))) == ["John", None, "Alice"]


def test_currency_and_number(spark):
    df = one(spark, ["$1,234.56", "€500", "-£10.5", None, "abc", "(5)"])
    assert column(df, V.currency_number(F.col("c"))) == [1234.56, 500.0, -10.5, None, None, 5.0]
    assert column(df, V.currency_number(F.col("c"), True))[-1] == -5.0
    assert column(one(spark, ["1,000", "2,500.5", None, "1d", "nan", "inf", "1e3", "0x1p3"]), V.plain_number(F.col("c"))) == [1000.0, 2500.5, None, None, None, None, 1000.0, None]


def test_contains_is_literal(spark):
    df = one(spark, ["A[B]", "AB", "C"])
    assert column(filter_rows(df, [Condition("c", "contains", "[B]")])) == ["A[B]"]
    texts = one(spark, ["A female clerk", "A male clerk", "The female lead"])
    assert filter_rows(texts, [Condition("c", "contains", "female")]).count() == 2
    assert filter_rows(texts, [Condition("c", "contains", "male")]).count() == 3


def test_in_matches_spellings(spark):
    df = one(spark, ["PayPal", "cash", "pay pal", "credit card", None])
    assert column(filter_rows(df, [Condition("c", "in", ["paypal", "cash"])])) == ["PayPal", "cash", "pay pal"]
    assert column(filter_rows(df, [Condition("c", "not_in", ["paypal", "cash"])])) == ["credit card", None]


def test_group_sum_replaces_table(spark):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), (None, 5)], "Cat string, Val long")
    out = A.grouped(df, "sum", ["Cat"], "Val", "TotalVal")
    assert out.columns == ["Cat", "TotalVal"]
    assert {r.Cat: r.TotalVal for r in out.collect()} == {"A": 30, "B": 30}


def test_clean_dedup_fill(spark):
    df = spark.createDataFrame([(" Alice ", 10.0), ("Bob", 20.0), ("Alice ", 10.0), (None, None)], "Name string, Score double")
    steps = [("trim_whitespace", {}), ("drop_duplicates", {}), ("fill_nulls", {"columns": ["Name"], "strategy": "constant", "value": "Unknown"}),
             ("fill_nulls", {"columns": ["Score"], "strategy": "zero"})]
    chain = U.run_chain(df, steps)
    assert sorted(tuple(r) for r in chain.df.collect()) == [("Alice", 10.0), ("Bob", 20.0), ("Unknown", 0.0)]
    audit = chain.audit().orderBy("step").collect()
    assert [(r.rows_in, r.rows_out) for r in audit] == [(4, 4), (4, 3), (3, 3), (3, 3)]
    assert {r.step_kind for r in audit} == {"user_requested"}


def test_drop_nulls_treats_blank_as_null(spark):
    df = spark.createDataFrame([("Female", "PhD", "Single"), ("Male", "Master", None), ("Female", "", "Single")], "gender string, education_level string, marital_status string")
    assert [tuple(r) for r in K.drop_nulls(df).collect()] == [("Female", "PhD", "Single")]
    assert K.drop_nulls(df, how="all").count() == 3


def test_or_with_projection(spark):
    df = spark.createDataFrame([("Paid", 100), ("Pending", 200), ("Failed", 50), ("Paid", 300)], "Status string, Amount long")
    out = filter_rows(df, [Condition("Status", "eq", "paid"), Condition("Amount", "gt", 150)], "or", select=["Amount"])
    assert sorted(column(out)) == [100, 200, 300]


def test_scalar_metrics(spark):
    df = spark.createDataFrame([("A", 100), ("A", 200), ("B", 300)], "Category string, Revenue long")
    row = A.metrics(df, [A.Metric("sum", "Revenue"), A.Metric("median", "Revenue"), A.Metric("variance", "Revenue", "v"), A.Metric("count_distinct", "Category")]).first()
    assert tuple(row) == (600.0, 200.0, 10000.0, 2)
    single = df.limit(0)
    assert A.metrics(single, [A.Metric("sum", "Revenue", "s"), A.Metric("mean", "Revenue", "m"), A.Metric("median", "Revenue", "d")]).first() == Row(s=0.0, m=None, d=None)
    with pytest.raises(TypeError):
        A.metrics(df, [A.Metric("sum", "Category")])


def test_conditional_percentage(spark):
    people = [("F", "single"), ("female", "Single"), (" Female", "married"), ("FEMALE", "single"), ("female", "divorced"), ("female", "divorced"), ("male", "married")]
    df = spark.createDataFrame(people, "gender string, marital_status string")
    row = A.conditional_percentage(df, "marital_status", "single", "gender", "female").first()
    assert tuple(row) == (40.0, 2, 5)
    with pytest.raises(Exception, match="no rows in the base"):
        A.conditional_percentage(df, "marital_status", "single", "gender", "none").collect()


def test_quarters(spark):
    rows = [(f"2026-{m:02d}-15", 11000 + 1333 * (m % 3)) for m in range(1, 13)] + [("no date", 99)]
    df = spark.createDataFrame(rows, "date string, revenue long")
    out = A.quarterly(df, "count", "date").collect()
    assert [(r[0], r[1], r[2]) for r in out] == [("2026Q1", 3, "2026-01-01"), ("2026Q2", 3, "2026-04-01"), ("2026Q3", 3, "2026-07-01"), ("2026Q4", 3, "2026-10-01")]


def test_cross_tab_needs_two_keys(spark):
    with pytest.raises(ValueError):
        A.cross_tab(one(spark, ["a"]), "count", ["c"])


def test_profile_and_guess(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, "open", "a b"), (dt.datetime(2024, 1, 2), None, "open", "c"), (dt.datetime(2024, 1, 3), 30.0, "closed", "d"),
            (dt.datetime(2024, 1, 4), 40.0, "open", "e"), (dt.datetime(2024, 1, 1), 10.0, "open", "a b")]
    df = spark.createDataFrame(rows, "Date timestamp, Revenue double, Status string, Notes string")
    assert tuple(P.table_profile(df).first()) == (5, 4, 1, False)
    profile = P.column_profile(df)
    nulls = {r.column: (r.null_count, r.distinct_count) for r in profile.collect()}
    assert nulls["Revenue"] == (1, 3) and nulls["Status"] == (0, 2)
    guess = {r.column: r.semantic_guess for r in P.semantic_guesses(profile, P.head_shares(df, F.col("Date"))).collect()}
    assert guess == {"Date": "date", "Revenue": "currency", "Status": "categorical", "Notes": "string"}


def test_samples_are_masked(spark):
    df = spark.createDataFrame([("ann@x.org", "4111 1111 1111 1234", "Bolt", 1), ("bob@x.org", "4000-0000-0000-9999", "Nut", 2)], "Customer_Email string, Card_Number string, Product_Name string, n int")
    counts = P.value_counts(df, F.col("n"), ["Customer_Email", "Card_Number", "Product_Name"])
    shown = {(r.column, r["rank"]): r.value for r in P.sample_values(counts, "representative").collect()}
    assert shown[("Customer_Email", 1)] == "a***@x.org"
    assert shown[("Card_Number", 2)] == "****9999"
    assert shown[("Product_Name", 1)] == "Bolt"


def test_rules(spark):
    df = spark.createDataFrame([(1, "Card"), (2, "PayPal"), (3, "pay pal")], "id int, payment_method string")
    found = Q.validate(df, [Q.Rule("payment_method", "forbidden_substring", value="PayPal")], ["id"]).collect()
    assert [(r.invalid_count, r.samples) for r in found] == [(2, ["PayPal", "pay pal"])]
    accounts = spark.createDataFrame([(1, "ACC100"), (2, "ZCC200"), (3, None)], "id int, account_number string")
    found = Q.validate(accounts, [Q.Rule("account_number", "starts_with", value="ACC"), Q.Rule("account_number", "length_range", high=9)], ["id"]).collect()
    assert [(r.rule, r.invalid_count, r.samples) for r in found] == [("starts_with", 1, ["ZCC200"])]
    dates = spark.createDataFrame([(1, "2024-01-01"), (2, "2029-01-01")], "id int, invoice_date string")
    assert Q.validate(dates, [Q.Rule("invoice_date", "date_not_future")], ["id"], now="2026-01-01").first().invalid_count == 1
    with pytest.raises(ValueError):
        Q.validate(dates, [Q.Rule("invoice_date", "date_not_future")], ["id"])


LEDGER = "file_row int, voucher_date string, entry_no string, sub_account string, details string, account_code string, class string, sub_class string, country string, region string, debit_amount string, credit_amount string"


def test_ledger(spark):
    rest = ("Cash", "text", "A1", "Asset", "Current", "IN", "South")
    rows = [(2, "2024-01-01", "1.1", *rest, "10.00", None), (3, "2024-01-01", "1.2", *rest, None, "10.00"), (4, "2024-01-01", "2.1", *rest, "5", "5"),
            (5, "2024-01-01", "2.2", *rest, None, None), (6, "2024-01-01", "3.1", *rest, "-1", None), (7, "2024-01-01", "3.2", *rest, "ten", None),
            (8, "2024-01-01", "12", *rest, "1", None), (9, "soon", "4.1", *rest, "1", None), (10, "2024-01-01", "4.2", "Cash", "text", " ", "Asset", "Current", "IN", "South", "1", None)]
    df = spark.createDataFrame(rows, LEDGER)
    errors = {(r.row, r.field, r.message) for r in Q.ledger_errors(df, "file_row").collect()}
    assert {(e[0], e[1]) for e in errors} == {(4, "debit_amount/credit_amount"), (5, "debit_amount/credit_amount"), (6, "debit_amount"), (7, "debit_amount"),
                                              (8, "entry_no"), (9, "voucher_date"), (10, "account_code")}
    assert tuple(Q.ledger_verdict(df).first()) == ("", 7, 7, False)
    assert tuple(Q.ledger_verdict(df.where("file_row < 4")).first()) == ("", 0, 0, True)
    assert [tuple(r) for r in df.limit(2).select(*V.entry_parts(F.col("entry_no"))).collect()] == [(1, 1), (1, 2)]


def test_values_reveal_columns(spark):
    df = spark.createDataFrame([(1, "Female", "PhD", "Single"), (2, "Male", "Master", "Married"), (3, "Female", "PhD", "Divorced")], "id int, gender string, education_level string, marital_status string")
    asked = spark.createDataFrame([("a", "female"), ("b", "phd"), ("c", "single")], "request string, value string")
    counts = P.value_counts(df, F.col("id"), ["gender", "education_level", "marital_status"])
    out = M.columns_holding(asked, "request", "value", counts, F.lit(0.0))
    assert {r.request: r.column for r in out.collect()} == {"a": "gender", "b": "education_level", "c": "marital_status"}
    domain = M.values_in_domain(spark.createDataFrame([("Female",), ("x",)], "w string"), "w", P.cells(df, F.col("id"), ["gender"]))
    assert {r.w: (r.matched, r.match_kind, r.match_count) for r in domain.collect()} == {"Female": (True, "exact", 1), "x": (False, "unresolved", 0)}


def test_token_and_name_scores(spark):
    pairs = spark.createDataFrame([("payment method", "payment_method"), ("amount", "total_amount"), ("abc", "xyz"), ("", "")], "a string, b string")
    assert column(pairs, M.token_overlap(M.features(F.col("a")), M.features(F.col("b")))) == [1.0, 0.5, 0.0, 0.0]
    assert column(pairs, M.name_similarity(M.features(F.col("a")), M.features(F.col("b"))))[2:] == [0.0, 1.0]
    assert column(one(spark, ["XMLParser"]), X.name_tokens(F.col("c"))) == [["xml", "parser"]]


def test_a_wide_catalogue_has_the_same_schema(spark):
    asked = spark.createDataFrame([("unit price",), ("field 7",)], "requested string").withColumn("f", M.features(F.col("requested")))
    for width in (40, 900):
        names = M.name_catalogue(spark, [f"field_{i}" for i in range(width)] + ["unit_price"])
        best = M.top_columns(asked, ["requested"], names, lambda c: M.token_overlap(F.col("f"), c["f"]))
        assert best.columns == ["requested", "score", "column"]
        assert {r.requested: r.column for r in best.collect()} == {"unit price": "unit_price", "field 7": "field_7"}
        two = M.top_columns(asked, ["requested"], names, lambda c: M.token_overlap(F.col("f"), c["f"]), k=2)
        assert two.columns == ["requested", "rank", "score", "column"] and two.count() == 4


def test_private_records(spark):
    df = spark.createDataFrame([("a", "s", 0.5), (None, "s", 0.1)], "x string, _source string, _confidence double")
    assert [tuple(r) for r in C.drop_private(df).collect()] == [("a",)]


def test_records_prefer_full_data(spark):
    payloads = ['{"cleaned_data": [{"a": 1}, {"a": 2}], "cleaned_preview": [{"a": 9}]}', '{"cleaned_preview": [{"a": 9}], "record_count": 4}', '{"cleaned_preview": [{"a": 9}], "record_count": "x"}', 'no json']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "k int, p string")
    assert sorted(tuple(r) for r in R.from_records(df, "k", "p", "a: bigint").collect()) == [(0, 1, 1), (0, 2, 2), (2, 1, 9)]


def test_csv_preview(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,amount,status\nann,1,ok\n\nbob,N/A,ok\n\"c, d\",3,null\n")
    df = R.read_delimited(spark, str(tmp_path), ["name", "amount", "status"])
    assert sorted(tuple(r) for r in df.collect()) == [("ann", "1", "ok"), ("bob", None, "ok"), ("c, d", "3", None)]
    assert R.count_delimited_rows(spark, str(tmp_path)).first()[0] == 3
    shown = R.preview(df, 2, ["name"]).collect()
    assert len(shown) == 2 and shown[0].row_count == 3
    a, b = R.file_facts(spark, str(tmp_path)), R.file_facts(spark, str(tmp_path))
    assert [r.verdict for r in R.drifted(a, b).collect()] == ["same"]


def test_lines_are_numbered_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \nthree")
    (tmp_path / "b.txt").write_text("x\n  \ny\n")
    got = sorted(tuple(r) for r in R.read_lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "three"), ("b.txt", 1, "x"), ("b.txt", 2, "y")]


def test_json_shapes(spark, tmp_path):
    for name, body in (("array", '[{"a": 1}, {"a": 2}]'), ("object", '{"a": 3}'), ("nested", '{"t": "x", "rows": [{"a": 4}, {"a": 5}]}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(body)
        assert [r.a for r in R.read_json_table(spark, str(tmp_path / name)).collect()] == {"array": [1, 2], "object": [3], "nested": [4, 5]}[name]


def test_records_are_replaced_per_key(spark, tmp_path):
    from tablewright.sources.sinks import replace_records

    path = str(tmp_path / "r")
    schema = "job long, record_index long, payload string"
    replace_records(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema), path, "job")
    replace_records(spark.createDataFrame([(1, 1, "new")], schema), path, "job")
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("job", "record_index", "payload").collect())
    assert got == [(1, 1, "new"), (2, 1, "c")]


def test_names(spark):
    assert [C.snake_name(n) for n in (" Full  Name", "customerID", "XMLParser", "a--b__c")] == ["full_name", "customer_id", "xml_parser", "a_b_c"]
    with pytest.raises(ValueError, match="collide"):
        C.normalize_names(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))
    with pytest.raises(C.MissingColumns):
        C.keep_columns(one(spark, ["x"]), ["y"])


def test_dates(spark):
    df = one(spark, ["2024-03-04", "03/04/2024", "25/12/2023", "4 Mar 2024", "2024/03/04", "2024-03-04T05:06:07", "2024-02-31", "soon", None])
    month = column(df, F.date_format(V.to_timestamp(F.col("c")), "yyyy-MM-dd"))
    assert month == ["2024-03-04", "2024-03-04", "2023-12-25", "2024-03-04", "2024-03-04", "2024-03-04", None, None, None]
    assert column(df, F.date_format(V.to_timestamp(F.col("c"), dayfirst=True), "yyyy-MM-dd"))[1] == "2024-04-03"
    with pytest.raises(Exception, match="not a date"):
        df.select(V.normalize_date(F.col("c"), errors="raise")).collect()


def test_coerce_errors(spark):
    df = one(spark, ["1", "x"])
    assert column(df, V.coerce_type(F.col("c"), "integer")) == [1, None]
    assert column(df, V.coerce_type(F.col("c"), "integer", "ignore")) == ["1", "x"]
    with pytest.raises(Exception, match="not a integer"):
        df.select(V.coerce_type(F.col("c"), "integer", "raise")).collect()


def test_unsafe_preparation_is_refused(spark):
    with pytest.raises(ValueError, match="not safe"):
        U.run_chain(one(spark, ["x"]), [("drop_nulls", {})], preparing=True)
    with pytest.raises(ValueError, match="unknown operation"):
        U.run_chain(one(spark, ["x"]), [("explode_rows", {})])


def test_aggregate_condition_with_median(spark):
    df = spark.createDataFrame([("a", "$1,000"), ("a", "$3,000"), ("b", "$2,000"), ("b", None)], "k string, v string")
    assert [r.v for r in filter_rows(df, [Condition("v", "gt", Aggregate("median", "v"))]).collect()] == ["$3,000"]
    assert [r.v for r in filter_rows(df, [Condition("v", "gte", Aggregate("max", "v", "k", "B"))]).orderBy("v").collect()] == ["$2,000", "$3,000"]


@pytest.mark.parametrize("kind", ["csv", "json", "txt", "bundle"])
def test_report_from_raw_table(spark, tmp_path, kind):
    from tablewright.plans.report import Request, build, write

    rows = [("PayPal ", "$10", "N"), ("cash", "$30", "N"), ("pay pal", "20", "S"), ("card", "$99", "S"), (None, "x", "S")]
    df = spark.createDataFrame(rows, "method string, amount string, region string")
    request = Request(
        cleaning=[("trim_whitespace", {}), ("normalize_currency", {"columns": ["amount"]})], conditions=[Condition("method", "in", ["paypal", "cash"])],
        calculations=[{"type": "sum", "column": "amount"}, {"type": "group_sum", "group_by": ["region"], "column": "amount", "output_column": "total_amount"},
                      {"type": "max", "column": "total_amount", "output_column": "top"}],
        charts=[{"title": "by region", "by": "region"}])
    report = build(df, request)
    assert {r.region: r.total_amount for r in report.calculated.df.collect()} == {"N": 40.0, "S": 20.0}
    assert report.calculated.metric_values() == {"sum_amount": 60.0, "top": 40.0}
    assert {r.region: r.value for r in report.charts["by region"].collect()} == {"N": 2, "S": 1}
    path = str(tmp_path / "out")
    write(report, path, kind, "Sums")
    if kind == "csv":
        assert R.read_delimited(spark, path, ["region", "total_amount"]).count() == 2
    elif kind == "json":
        assert spark.read.json(f"{path}/data").count() == 2 and spark.read.json(f"{path}/metadata").first().title == "Sums"
    elif kind == "txt":
        assert [r.value for r in spark.read.text(f"{path}/head").collect()][:2] == ["Sums", "===="]
    else:
        log = spark.read.parquet(f"{path}/audit_log").orderBy("step").collect()
        assert [(r.rows_in, r.rows_out) for r in log] == [(5, 5), (5, 5)]
        assert spark.read.parquet(f"{path}/warnings").columns == ["warning"]


def test_filter_preparation_comes_first_when_nothing_is_cleaned(spark):
    from tablewright.plans.report import Request, build

    df = spark.createDataFrame([(" 10 ", "A"), ("20", "b"), ("30", " a ")], "`Total Amount` string, kind string")
    report = build(df, Request(prepare=True, conditions=[Condition("total_amount", "gt", 5), Condition("kind", "eq", "a")]))
    assert sorted(r.total_amount for r in report.filtered.collect()) == [10.0, 30.0]
    assert report.calculated.warnings == []


def test_warnings_of_ordered_calculations(spark):
    from tablewright.plans.calculations import calculate

    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i, i % 2) for i in range(10)], "id int, shop string, v long, z long")
    out = calculate(df, [{"type": "running_total", "column": "v", "sort_by": ["id"], "output_column": "run"}, {"type": "ratio", "column": "v", "secondary_column": "z"}])
    assert len(out.warnings) == 2 and "shop" in out.warnings[0] and "5 rows" in out.warnings[1]
    assert [r.run for r in out.df.orderBy("id").collect()] == [sum(range(i + 1)) for i in range(10)]


def test_blank_rules_state_nothing(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "c string, d string")
    rules = [Q.Rule("c", "forbidden_substring", value="--"), Q.Rule("c", "contains", value=None), Q.Rule("c", "allowed_values", values=()), Q.Rule("c", "allowed_values", values=(" ",)),
             Q.Rule("c", "not_allowed_values", values=(None,))]
    assert Q.validate(df, rules, ["d"]).count() == 0
    none = Q.validate(df, [Q.Rule("absent", "required")], ["d"])
    assert none.count() == 0 and none.columns == ["column", "rule", "severity", "reason", "invalid_count", "samples"]


def test_rule_defaults_and_star(spark):
    df = spark.createDataFrame([("5", "50"), ("200", None)], "a string, b string")
    got = {(r.column, r.rule): (r.severity, r.invalid_count) for r in Q.validate(df, [Q.Rule("*", "numeric_range", low=0, high=100), Q.Rule("b", "required")], ["a"]).collect()}
    assert got == {("a", "numeric_range"): ("warning", 1), ("b", "required"): ("error", 1)}


def test_constant_of_another_type(spark):
    from tablewright.operators.clean import fill_nulls

    df = spark.createDataFrame([(1, None), (None, "x")], "n int, s string")
    assert [tuple(r) for r in fill_nulls(df, ["n", "s"], "constant", "none").collect()] == [("1", "none"), ("none", "x")]
    assert [tuple(r) for r in fill_nulls(df, ["n"], "constant", 7).collect()] == [(1, None), (7, "x")]


def test_operator_words(spark):
    from tablewright.functions import predicates as P

    words = {"is_equal": "eq", "greater_than_or_equal_to": "gte", "less_than_or_equal_to": "lte", "contains_any": "in", "not_in_list": "not_in", "like": "matches", "Regex": "matches"}
    assert {w: P.canonical_operator(w) for w in words} == words
    df = spark.createDataFrame([("Alpha",), ("beta",), (None,)], "c string")
    assert [r.c for r in df.where(P.predicate(F.col("c"), "string", "like", "^al")).collect()] == ["Alpha"]


def test_snake_case_after_a_sign():
    from tablewright.operators.columns import snake_name

    assert [snake_name(n) for n in ("Price/Unit", "HTTPServer", "totalAmount", "Order ID", "XMLParser")] == ["price/_unit", "http_server", "total_amount", "order_id", "xml_parser"]


def test_limit_needs_an_order(spark):
    from tablewright.operators.filters import filter_rows

    with pytest.raises(ValueError):
        filter_rows(spark.range(3), [], limit=1)
    assert [r.id for r in filter_rows(spark.range(3), [], limit=2, order=["id"]).collect()] == [0, 1]


def test_map_columns_settle_no_ties(spark):
    from tablewright.operators.ordered import running_total
    from tablewright.streaming.events import once_batch

    df = spark.createDataFrame([(1, 5, {"a": "b"}), (2, 7, {}), (2, 7, None)], "k int, n int, m map<string,string>").withColumn("ts", F.col("k")).withColumn("event_id", F.col("k"))
    assert sorted(r.running_total_n for r in running_total(df, "n", ["k"]).collect()) == [5, 12, 19]
    assert K.drop_duplicates(df, ["k"], order=["n"]).count() == 2
    assert once_batch(df).count() == 2


def test_styles_of_acronyms_and_digits():
    names = ("HTTPServer2Port", "order2Item", "_Total__Amount ", "A", "iPhone 15-Pro", "__", "ABC")
    assert [C.styled_name(n, "snake_case") for n in names] == ["http_server2_port", "order2_item", "total_amount", "a", "i_phone_15_pro", "", "abc"]
    assert [C.styled_name(n, "camel_case") for n in names] == ["httpServer2Port", "order2Item", "totalAmount", "a", "iPhone15Pro", "", "abc"]
    assert [C.styled_name(n, "pascal_case") for n in names] == ["HttpServer2Port", "Order2Item", "TotalAmount", "A", "IPhone15Pro", "", "Abc"]
    assert C.styled_name("  Mixed Case ", "lowercase") == "mixed case"


def test_distinct_counts_are_spread_and_exact(spark, monkeypatch):
    """Values are counted on rows dealt to several tasks, without a row for each column of a row that carries all others; equal values count once."""
    rows = [(i, float(i % 3), -0.0 if i % 2 else 0.0, float("nan"), dt.datetime(2024, 1, 1, 0, 0, 0, i % 5), f"v{i % 50}", None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double, zero double, n double, at timestamp, v string, none string").coalesce(1)
    want = {"id": 1000, "x": 3, "zero": 1, "n": 1, "at": 5, "v": 50, "none": 0}
    monkeypatch.setattr(P, "TASK_CELLS", 700)
    profile, lean = P.column_profile(df), P.lean_profile(df.drop("zero", "n", "at"), F.col("id"))
    assert {r.column: r.distinct_count for r in profile.collect()} == want
    assert {r.column: r.distinct_count for r in lean.collect()} == {c: want[c] for c in ("id", "x", "v", "none")}
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "RepartitionByExpression" in plan
