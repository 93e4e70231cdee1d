"""Role mapping from the driver tables to the reference's data model.

The reference works on a wide order ("lead") table joined with contact
attributes. Here the same roles are played by ``orders`` joined with
``customer`` and ``nation``. Each derived view is declared once as a list of
``(alias, spark_sql_expr, duckdb_expr)`` so the Spark plan (``selectExpr`` on
parquet scans, Catalyst-pruned) and the DuckDB oracle see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _same(alias, expr):
    return (alias, expr, expr)


# --------------------------------------------------------------- leads view
# orders (1 row per lead) + customer (contact) + nation (25 rows, fixed size).
LEAD_COLUMNS = [
    _same("lead_id", "o_orderkey"),
    _same("contact_id", "o_custkey"),
    _same("buyout_flag", "CAST(o_orderstatus = 'F' AS INT)"),
    _same("sale_dt", "o_orderdate"),
    ("sale_ts", "CAST(unix_timestamp(o_orderdate) AS BIGINT)", "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("created_ms",
     "CAST(unix_timestamp(o_orderdate) AS BIGINT) * 1000 - (o_orderkey % 5) * 86400000",
     "CAST(epoch(o_orderdate) AS BIGINT) * 1000 - (o_orderkey % 5) * 86400000"),
    ("delivered_ts",
     "CAST(unix_timestamp(o_orderdate) AS BIGINT) + (o_orderkey % 11) * 86400 - 2 * 86400",
     "CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 11) * 86400 - 2 * 86400"),
    ("sale_date_text", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    _same("amount", "o_totalprice"),
    _same("price", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"),
    _same("priority", "NULLIF(o_orderpriority, '4-NOT SPECIFIED')"),
    _same("status", "o_orderstatus"),
    _same("segment", "c_mktsegment"),
    _same("segment_copy", "c_mktsegment"),
    _same("segment_near", "CASE WHEN o_orderkey % 33 = 0 THEN 'OTHER' ELSE c_mktsegment END"),
    _same("nation", "n_name"),
    _same("acctbal", "c_acctbal"),
    _same("const_col", "'x'"),
    _same("mostly_empty", "CASE WHEN o_orderkey % 50 = 0 THEN 'a' ELSE 'nan' END"),
    _same("cust_name", "c_name"),
    _same("pickup_text", "'x-' || upper(substr(n_name, 1, 3)) || CAST(n_nationkey AS STRING)"),
    _same("owner_a", "c_nationkey"),
    _same("owner_b", "CASE WHEN o_orderkey % 9 = 0 THEN NULL "
                     "WHEN o_orderkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END"),
    _same("score", "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0"),
]

LEADS_FROM = ("orders JOIN customer ON o_custkey = c_custkey "
              "JOIN nation ON c_nationkey = n_nationkey")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")  # TPC-H nation: fixed 25 rows -> broadcast is bounded
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.selectExpr(*[f"{s} AS {a}" for a, s, _ in LEAD_COLUMNS])


def leads_sql(cols: list[str] | None = None) -> str:
    sel = [f"{d} AS {a}" for a, _, d in LEAD_COLUMNS if cols is None or a in cols]
    return f"SELECT {', '.join(sel)} FROM {LEADS_FROM}"


def with_cte(body: str, **views: str) -> str:
    ctes = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {ctes} {body}"


# ---------------------------------------------------------- lineitem view
LINE_COLUMNS = [
    _same("lead_id", "l_orderkey * 10 + l_linenumber"),
    _same("order_id", "l_orderkey"),
    _same("contact_id", "l_suppkey"),
    _same("part_id", "l_partkey"),
    _same("y", "CAST(l_returnflag = 'R' AS INT)"),
    _same("quantity", "l_quantity"),
    _same("price", "l_extendedprice"),
    _same("discount", "l_discount"),
    _same("tax", "l_tax"),
    _same("width", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"),
    _same("height", "CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_tax * 100 END"),
    _same("status", "l_linestatus"),
    _same("ship_dt", "l_shipdate"),
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"{s} AS {a}" for a, s, _ in LINE_COLUMNS])


def lines_sql() -> str:
    return f"SELECT {', '.join(f'{d} AS {a}' for a, _, d in LINE_COLUMNS)} FROM lineitem"
