"""Catalogued queries: sources, profiling and audit (§2.1, §2.2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsieve.operators import profile as P
from tabsieve.operators.encode import top_k_group
from tabsieve.plans.inputs import LEAD_COLUMNS, leads, leads_sql, read, with_cte
from tabsieve.plans.registry import (
    d_empty, d_level_stats, d_long, d_norm, d_value_counts, dq, query,
)
from tabsieve.session import checkpoint_dir
from tabsieve.sources import io as IO

ALL = [a for a, _, _ in LEAD_COLUMNS]
# columns whose text form is identical in Spark and DuckDB (no doubles, no timestamps)
TEXTY = ["lead_id", "contact_id", "buyout_flag", "sale_ts", "created_ms", "sale_date_text",
         "priority", "status", "segment", "segment_copy", "segment_near", "nation", "const_col",
         "mostly_empty", "cust_name", "pickup_text", "owner_a", "owner_b"]
STRINGS = ["sale_date_text", "priority", "status", "segment", "segment_copy", "segment_near",
           "nation", "const_col", "mostly_empty", "cust_name", "pickup_text"]
L = leads_sql()


# ------------------------------------------------------------------ sources
def _scan_csv(spark, sf):
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    src = leads(spark, sf).select("lead_id", "contact_id", "buyout_flag", "priority", "segment",
                                  "amount")
    IO.write_table(src, path, fmt="csv")
    schema = "lead_id bigint, contact_id bigint, buyout_flag int, priority string, segment string, amount double"
    return IO.scan_csv(spark, path, schema=schema)


query("scan_csv", with_cte("SELECT lead_id, contact_id, buyout_flag, priority, segment, amount FROM l",
                           l=L))(_scan_csv)


@query("scan_csv_checked", with_cte(
    "SELECT CASE WHEN lead_id % 50 = 0 OR lead_id % 71 = 0 OR lead_id % 83 = 0 THEN 'rejected' ELSE 'read' END AS kind, count(*) AS n, "
    "CAST(sum(CASE WHEN lead_id % 50 = 0 OR lead_id % 71 = 0 OR lead_id % 83 = 0 THEN 0 ELSE lead_id END) AS BIGINT) AS id_sum FROM l "
    "GROUP BY 1", l=L))
def _scan_csv_checked(spark, sf):
    """A table with values of another type, short lines and long lines, written as text and read back."""
    base = f"{checkpoint_dir(spark)}/checked-csv-{uuid.uuid4().hex}"
    i = F.col("lead_id")
    amount = F.when(i % 50 == 0, "n/a").otherwise(F.floor("amount").cast("string"))
    line = F.when(i % 71 == 0, i.cast("string")).otherwise(F.concat_ws(
        ",", i.cast("string"), amount, F.col("buyout_flag").cast("string"), F.when(i % 83 == 0, F.lit("more,fields"))))
    leads(spark, sf).select(line.alias("value")).write.text(f"{base}/in")
    rows, rejected = IO.scan_csv_checked(spark, f"{base}/in", "lead_id long, amount long, buyout_flag int", f"{base}/out", header=False)
    return (rows.select(F.lit("read").alias("kind"), "lead_id").union(rejected.select(F.lit("rejected"), F.lit(0).cast("long")))
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("lead_id").alias("id_sum")))


@query("load_labelled", with_cte(
    "SELECT lead_id, CAST(y AS INT) AS buyout_flag, sale_dt FROM "
    "(SELECT lead_id, CASE WHEN priority = '1-URGENT' THEN NULL ELSE buyout_flag END AS y, "
    "CASE WHEN lead_id % 13 = 0 THEN NULL ELSE sale_dt END AS sale_dt FROM l) "
    "WHERE y IS NOT NULL AND sale_dt IS NOT NULL", l=L))
def _load_labelled(spark, sf):
    df = leads(spark, sf).select(
        "lead_id",
        F.when(F.col("priority") == "1-URGENT", None).otherwise(F.col("buyout_flag")).alias("buyout_flag"),
        F.when(F.col("lead_id") % 13 == 0, None).otherwise(F.col("sale_dt")).alias("sale_dt"))
    return IO.load_labelled(df, "buyout_flag", time_col="sale_dt")


@query("load_reference_table",
       "SELECT r_name AS region, n_name AS city, 'x-' || upper(substr(n_name, 1, 3)) || "
       "CAST(n_nationkey AS STRING) AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
def _load_reference_table(spark, sf):
    return IO.load_reference_table(spark, sf)


def _scan_block_dir(spark, sf):
    base = f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    df = leads(spark, sf)
    IO.write_table(df.select(F.col("lead_id").alias("row_id"), "segment", "nation"), f"{base}/b1", fmt="csv")
    IO.write_table(df.select(F.col("lead_id").alias("row_id"), "priority", "status"), f"{base}/b2", fmt="csv")
    blocks = IO.scan_block_dir(spark, [f"{base}/b1", f"{base}/b2"], key="row_id",
                               schemas=["row_id bigint, segment string, nation string",
                                        "row_id bigint, priority string, status string"])
    from tabsieve.operators.joins import assemble_blocks
    return assemble_blocks(blocks, key="row_id")


query("scan_block_dir", with_cte("SELECT lead_id AS row_id, segment, nation, priority, status FROM l",
                                 l=L))(_scan_block_dir)


def _write_table(spark, sf):
    path = f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"
    df = leads(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum("buyout_flag").cast("bigint").alias("positives"))
    IO.write_table(df, path, fmt="parquet")
    return spark.read.parquet(path)


query("write_table", with_cte("SELECT segment, count(*) AS n, CAST(sum(buyout_flag) AS BIGINT) AS positives "
                              "FROM l GROUP BY segment", l=L))(_write_table)


def _write_audit_report(spark, sf):
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    df = leads(spark, sf).select(*TEXTY)
    f1 = P.drop_empty_columns(df)
    f2 = P.dominant_value(f1.apply(df))
    IO.write_audit_report([(f1, df), (f2, f1.apply(df))], path, target="buyout_flag")
    return spark.read.json(f"{path}/steps").select(
        "step", "analyzer", "feature", F.col("rows_before").cast("bigint").alias("rows_before"),
        F.col("cols_before").cast("bigint").alias("cols_before"),
        F.col("cols_after").cast("bigint").alias("cols_after"))


def _report_oracle():
    from tabsieve.plans.catalog_models import _cleaning_sql
    return _cleaning_sql(TEXTY, ("empty", "dominant"), step_type="BIGINT", count_type="BIGINT")


query("write_audit_report", None)(_write_audit_report)


# ------------------------------------------------------------------ profile
@query("normalize_text", with_cte(
    f"SELECT lead_id, {d_norm('padded')} AS normalized FROM "
    "(SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN NULL ELSE '  ' || segment || chr(9) END AS padded FROM l)",
    l=L))
def _normalize_text(spark, sf):
    from tabsieve.functions.text import normalize_text
    df = leads(spark, sf).select(
        "lead_id", F.when(F.col("lead_id") % 3 == 0, None)
        .otherwise(F.concat(F.lit("  "), F.col("segment"), F.lit("\t"))).alias("padded"))
    return df.select("lead_id", normalize_text("padded").alias("normalized"))


@query("empty_share", with_cte(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({d_empty(c)} AS DOUBLE)) AS empty_share FROM l"
                       for c in ALL), l=L))
def _empty_share(spark, sf):
    return P.empty_share(leads(spark, sf))


@query("drop_empty_columns", with_cte(
    "SELECT feature, round(empty_share, 4) AS empty_share FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({d_empty(c)} AS DOUBLE)) AS empty_share FROM l"
        for c in ALL) + ") WHERE empty_share >= 0.95", l=L))
def _drop_empty_columns(spark, sf):
    return P.drop_empty_columns(leads(spark, sf)).table


@query("value_counts_long", with_cte(d_value_counts("l", TEXTY), l=L))
def _value_counts_long(spark, sf):
    return P.value_counts_long(leads(spark, sf), TEXTY)


@query("dominant_value", with_cte(
    "SELECT feature, top_value, top_count, non_empty_count, "
    "round(top_count / non_empty_count, 4) AS top_share, nunique "
    f"FROM ({d_level_stats('l', TEXTY)}) WHERE non_empty_count >= 3 "
    "AND top_count / non_empty_count >= 0.3", l=L))
def _dominant_value(spark, sf):
    return P.dominant_value(leads(spark, sf), TEXTY, threshold=0.3).table


@query("high_cardinality", with_cte(
    "SELECT feature, nunique, non_empty_count, round(nunique / non_empty_count, 4) AS unique_share "
    f"FROM ({d_level_stats('l', STRINGS)}) WHERE nunique >= 50 AND nunique / non_empty_count >= 0.05",
    l=L))
def _high_cardinality(spark, sf):
    return P.high_cardinality(leads(spark, sf), share_threshold=0.05).table


def _pairs_sql(cols):
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    parts = []
    for a, b in pairs:
        x, y = d_norm(a), d_norm(b)
        parts.append(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", "
            f"CAST(sum(CAST({x} <> {y} AS INT)) AS BIGINT) AS mismatches, "
            f"CAST(sum(CAST(NOT ({x} = '' AND {y} = '') AS INT)) AS BIGINT) AS comparable, "
            f"CAST(sum(CAST({x} = {y} AND NOT ({x} = '' AND {y} = '') AS INT)) AS BIGINT) AS equal_comparable "
            f"FROM l")
    return " UNION ALL ".join(parts)


@query("exact_duplicate_columns", with_cte(
    f'SELECT "left", "right", 1.0::DOUBLE AS similarity FROM ({_pairs_sql(STRINGS)}) WHERE mismatches = 0',
    l=L))
def _exact_dups(spark, sf):
    exact, _ = P.duplicate_columns(leads(spark, sf), STRINGS)
    return exact.table


@query("near_duplicate_columns", with_cte(
    'SELECT "left", "right", round(CASE WHEN comparable > 0 THEN equal_comparable / comparable ELSE 0.0 END, 4) '
    f'AS similarity FROM ({_pairs_sql(STRINGS)}) WHERE mismatches > 0 AND '
    'CASE WHEN comparable > 0 THEN equal_comparable / comparable ELSE 0.0 END >= 0.95', l=L))
def _near_dups(spark, sf):
    _, near = P.duplicate_columns(leads(spark, sf), STRINGS)
    return near.table


@query("manual_drop", with_cte(
    "SELECT " + ", ".join(a for a in ALL if a not in ("status", "const_col")) + " FROM l", l=L))
def _manual_drop(spark, sf):
    df = leads(spark, sf)
    f = P.manual_drop(df, {"status": "post-event status", "missing_col": "absent",
                           "const_col": "constant"})
    return f.apply(df)


@query("column_match_rate", with_cte(
    "SELECT avg(CAST(coalesce(owner_a = owner_b, false) AS DOUBLE)) AS match_rate FROM l", l=L))
def _column_match_rate(spark, sf):
    return P.column_match_rate(leads(spark, sf), "owner_a", "owner_b")


@query("order_share", with_cte(
    "SELECT avg(CAST(coalesce(sale_ts * 1000 > created_ms, false) AS DOUBLE)) AS order_share FROM l", l=L))
def _order_share(spark, sf):
    df = leads(spark, sf).withColumn("sale_ms", F.col("sale_ts") * 1000)
    return P.order_share(df, "sale_ms", "created_ms")


@query("missing_share", with_cte(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CAST({dq(c)} IS NULL AS DOUBLE)) * 100.0 AS missing_pct FROM l"
    for c in ALL), l=L))
def _missing_share(spark, sf):
    return P.missing_share(leads(spark, sf))


_NUM = ["price", "amount", "acctbal"]


def _outlier_sql():
    parts = []
    for c in _NUM:
        parts.append(
            f"SELECT '{c}' AS feature, round(sum(CAST({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) AS DOUBLE)) "
            f"/ count({c}) * 100.0, 6) AS outlier_pct FROM l, (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3 FROM l) qq")
    return " UNION ALL ".join(parts)


@query("outlier_share", with_cte(_outlier_sql(), l=L))
def _outlier_share(spark, sf):
    return P.outlier_share(leads(spark, sf), _NUM).select(
        "feature", F.round("outlier_pct", 6).alias("outlier_pct"))


@query("numeric_vs_text_levels", with_cte(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, "
    f"count(DISTINCT CASE WHEN {c} IS NOT NULL AND try_cast({d_norm(c)} AS DOUBLE) IS NOT NULL THEN {d_norm(c)} END) AS numeric_levels, "
    f"count(DISTINCT CASE WHEN {c} IS NOT NULL AND try_cast({d_norm(c)} AS DOUBLE) IS NULL THEN {d_norm(c)} END) AS text_levels FROM "
    f"(SELECT CASE WHEN lead_id % 4 = 0 THEN 'n/a' ELSE CAST(owner_a AS STRING) END AS mixed, priority, pickup_text FROM l)"
    for c in ["mixed", "priority", "pickup_text"]), l=L))
def _numeric_vs_text(spark, sf):
    df = leads(spark, sf).select(
        F.when(F.col("lead_id") % 4 == 0, F.lit("n/a")).otherwise(F.col("owner_a").cast("string")).alias("mixed"),
        "priority", "pickup_text")
    return P.numeric_vs_text_levels(df)


@query("describe_column", with_cte(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM l" for c in _NUM), l=L))
def _describe(spark, sf):
    d = P.describe_column(leads(spark, sf), _NUM)
    return d.select("feature", "n", *[F.round(c, 6).alias(c) for c in ["mean", "std"]],
                    "min", *[F.round(c, 6).alias(c) for c in ["p25", "p50", "p75"]], "max")


def _kind(c):
    num = {"lead_id", "contact_id", "buyout_flag", "sale_ts", "created_ms", "delivered_ts", "amount",
           "price", "acctbal", "owner_a", "owner_b", "score"}
    return "numeric" if c in num else ("datetime" if c == "sale_dt" else "categorical")


@query("split_columns_by_type", with_cte(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{_kind(c)}' AS kind, count({dq(c)}) AS non_null FROM l" for c in ALL), l=L))
def _split_by_type(spark, sf):
    return P.split_columns_by_type(leads(spark, sf))


@query("target_rate_by_level", with_cte(
    "SELECT segment, count(buyout_flag) AS n, round(avg(CAST(buyout_flag AS DOUBLE)), 6) AS target_rate "
    "FROM l GROUP BY segment", l=L))
def _target_rate(spark, sf):
    return P.target_rate_by_level(leads(spark, sf), "segment", "buyout_flag").select(
        "segment", "n", F.round("target_rate", 6).alias("target_rate"))


@query("top_k_group", with_cte(
    "SELECT lead_id, CASE WHEN nation IN (SELECT v FROM top) THEN nation ELSE 'other' END AS nation_top "
    "FROM l", l=L,
    top="SELECT v FROM (SELECT nation AS v, count(*) AS n FROM l WHERE nation IS NOT NULL "
        "GROUP BY nation ORDER BY n DESC, v LIMIT 10)"))
def _top_k_group(spark, sf):
    df = leads(spark, sf)
    return top_k_group(df, "nation", 10, out="nation_top").select("lead_id", "nation_top")
