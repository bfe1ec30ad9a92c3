"""Registry of queries with their SQL twins, and the input views both sides share.

The given tables hold clean values and no job store, so each shared view derives a messy sheet or a job
table from them. A view is one SQL text that Spark and the SQL twin both run, so both see the same input;
every view covers all rows of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MONEY = "cast(cast(c_acctbal AS decimal(12,2)) AS string)"
_ISO = ("concat('20', lpad(cast(10 + c_custkey % 14 AS string), 2, '0'), '-', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'),"
        " '-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0'))")
_SLASH = ("concat(lpad(cast(13 + c_custkey % 15 AS string), 2, '0'), '/', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'),"
          " '/20', lpad(cast(10 + c_custkey % 14 AS string), 2, '0'))")

VIEWS = {
    # a spreadsheet as users hand it in: padding, mixed case, blanks, money text, several date layouts
    "sheet": f"""
SELECT c_custkey AS id,
  concat(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE '' END, c_name, CASE WHEN c_custkey % 5 = 0 THEN chr(9) ELSE '' END) AS full_name,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN upper(c_mktsegment) WHEN 3 THEN concat(' ', lower(c_mktsegment))
    WHEN 4 THEN concat(substr(c_mktsegment, 1, 4), '-', substr(c_mktsegment, 5)) ELSE c_mktsegment END AS segment,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('$', {_MONEY}) WHEN 2 THEN concat('€', {_MONEY})
    WHEN 3 THEN concat({_MONEY}, ' USD') WHEN 4 THEN {_MONEY} ELSE concat('-', {_MONEY}) END AS balance_text,
  CASE c_custkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL
    ELSE concat(cast(1 + c_custkey % 9 AS string), ',', lpad(cast(c_custkey % 1000 AS string), 3, '0')) END AS quantity_text,
  CASE c_custkey % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL WHEN 2 THEN {_SLASH} ELSE {_ISO} END AS joined_text,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN -c_acctbal ELSE c_acctbal END AS balance,
  CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' female' WHEN 2 THEN 'Others' ELSE 'male' END AS gender,
  CASE c_custkey % 10 WHEN 0 THEN NULL ELSE concat('user', cast(c_custkey AS string), '@example.com') END AS email,
  CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'true' WHEN 3 THEN 'maybe' ELSE NULL END AS active_text,
  cast(c_nationkey AS bigint) AS nation,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(c_custkey % 7 AS bigint) END AS visits,
  cast(NULL AS string) AS notes
FROM customer""",
    # jobs: status, payload status, timestamps and owner from orders
    "jobs": """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS uploaded_at, o_totalprice AS amount,
  status, payload_status,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL '1' MINUTE * cast(o_orderkey % 50 AS int) END AS dispatched_at,
  CASE WHEN status IN ('succeeded', 'complete', 'failed', 'callback_failed', 'declined', 'partial', 'awaiting_confirmation', 'quarantined')
    THEN o_orderdate + INTERVAL '1' MINUTE * cast(o_orderkey * 37 % 7919 AS int) END AS completed_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'json' WHEN 3 THEN NULL ELSE 'csv' END AS output_format,
  concat('file_', cast(o_orderkey % 100 AS string), '.csv') AS file_name,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - o_orderkey % 12 END AS parent_id
FROM (
  SELECT *, CASE
      WHEN o_orderstatus = 'F' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'failed' WHEN '2' THEN 'callback_failed'
        WHEN '3' THEN 'declined' WHEN '4' THEN 'partial' ELSE 'rejected' END
      WHEN o_orderstatus = 'O' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'queued' WHEN '2' THEN 'planning'
        WHEN '3' THEN 'running' WHEN '4' THEN 'pending' ELSE 'processing' END
      ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'succeeded' WHEN '2' THEN 'complete'
        WHEN '3' THEN 'awaiting_confirmation' WHEN '4' THEN 'awaiting_schema_approval' ELSE 'quarantined' END
    END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'pending_agent_availability' WHEN 1 THEN 'rejected' WHEN 2 THEN 'ok' ELSE NULL END AS payload_status
  FROM orders) AS o""",
    # ledger text as handed in, with broken rows of every kind
    "ledger": """
SELECT l_orderkey AS voucher_id, cast(l_linenumber AS bigint) AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
  CASE l_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' ELSE substr(cast(l_shipdate AS string), 1, 10) END AS voucher_date,
  CASE l_partkey % 19 WHEN 0 THEN cast(l_orderkey AS string) WHEN 1 THEN concat(cast(l_orderkey AS string), '.x')
    ELSE concat(cast(l_orderkey AS string), '.', cast(l_linenumber AS string)) END AS entry_no,
  CASE l_suppkey % 23 WHEN 0 THEN '  ' ELSE concat('ACC', cast(l_suppkey AS string)) END AS account_code,
  CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'ten' WHEN l_partkey % 37 = 0 THEN '-5.00'
    WHEN l_linenumber % 2 = 1 OR l_partkey % 41 = 0 THEN cast(cast(l_extendedprice AS decimal(14,2)) AS string) END AS debit_amount,
  CASE WHEN l_partkey % 29 = 0 THEN NULL
    WHEN l_linenumber % 2 = 0 OR l_partkey % 41 = 0 THEN cast(cast(l_extendedprice AS decimal(14,2)) AS string) END AS credit_amount
FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view as a lazy DataFrame."""
    source = {"sheet": "customer", "jobs": "orders", "ledger": "lineitem"}[name]
    sql = VIEWS[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names shared views the SQL twin needs in front."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            text = sql.strip()
            if uses:
                views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in uses)
                text = f"WITH {views}{',' + text[4:] if text.upper().startswith('WITH ') else chr(10) + text}"
            ORACLE[name] = text
        return fn

    return register
