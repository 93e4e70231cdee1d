"""Catalogued queries: dates (§2.3), association (§2.4), joins (§2.7), ordered (§2.8),
aggregation/time series (§2.9), splits and metrics (§2.10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsieve.operators import assoc as A
from tabsieve.operators import dates as D
from tabsieve.operators import evaluate as V
from tabsieve.operators import joins as J
from tabsieve.operators import ordered as O
from tabsieve.plans.inputs import leads, leads_sql, read, with_cte
from tabsieve.plans.registry import d_norm, query
from tabsieve.session import checkpoint_dir
from tabsieve.sources.io import load_reference_table

L = leads_sql()
_EPOCH = ["shift_ts", "shift_created_ms", "delivered_ts", "amount", "sale_date_text"]
_SHIFT = "SELECT *, sale_ts + 315576000 AS shift_ts, created_ms + 315576000000 AS shift_created_ms FROM l0"


def _shifted(spark, sf):
    return leads(spark, sf).withColumn("shift_ts", F.col("sale_ts") + 315576000).withColumn(
        "shift_created_ms", F.col("created_ms") + 315576000000)


def _r(c, d=6):
    return F.round(c, d)


def _share_sql(cols):
    parts = []
    for c in cols:
        t = d_norm(c)
        num = f"CASE WHEN isnan(TRY_CAST({t} AS DOUBLE)) THEN NULL ELSE TRY_CAST({t} AS DOUBLE) END"
        sh = lambda cond: f"sum(CASE WHEN {c} IS NOT NULL THEN CAST(coalesce({cond}, false) AS DOUBLE) END) / sum(CAST({c} IS NOT NULL AS DOUBLE))"
        parse = f"coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%d.%m.%Y')) IS NOT NULL"
        parts.append(
            f"SELECT '{c}' AS feature, {sh(f'{num} IS NOT NULL')} AS numeric_share, "
            f"{sh(f'{num} BETWEEN 946684800 AND 2082758400')} AS s_share, "
            f"{sh(f'{num} BETWEEN 946684800000 AND 2082758400000')} AS ms_share, "
            rf"{sh(f'regexp_matches({t}, ' + chr(39) + r'^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})' + chr(39) + ')')} AS pattern_share, "
            f"{sh(parse)} AS parse_share FROM l")
    return " UNION ALL ".join(parts)


# ------------------------------------------------------------------ §2.3
@query("detect_epoch_columns", with_cte(
    "SELECT feature, CASE WHEN ms_share >= s_share THEN 'ms' ELSE 's' END AS best_unit, "
    "round(greatest(ms_share, s_share), 6) AS best_share FROM sh WHERE feature IN ('shift_ts', 'shift_created_ms', "
    "'delivered_ts', 'sale_date_text') AND numeric_share >= 0.8 AND greatest(ms_share, s_share) >= 0.8",
    l0=L, l=_SHIFT, sh=_share_sql(_EPOCH)))
def _detect_epoch(spark, sf):
    sh = D.date_shares(_shifted(spark, sf), _EPOCH)
    return D.detect_epoch_columns(sh).select("feature", "best_unit", _r(F.col("best_share")).alias("best_share"))


@query("detect_date_strings", with_cte(
    "SELECT feature, round(pattern_share, 6) AS pattern_share, round(parse_share, 6) AS parse_share FROM sh "
    "WHERE pattern_share >= 0.5 AND parse_share >= 0.8", l0=L, l=_SHIFT, sh=_share_sql(_EPOCH)))
def _detect_strings(spark, sf):
    sh = D.date_shares(_shifted(spark, sf), _EPOCH)
    return D.detect_date_strings(sh).select("feature", _r(F.col("pattern_share")).alias("pattern_share"),
                                            _r(F.col("parse_share")).alias("parse_share"))


@query("date_candidates", with_cte(
    "SELECT feature, kind, best_unit, round(share, 4) AS parse_success_share, ends_with(feature, '_ts') AS has_ts_suffix "
    "FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY share DESC, kind = 'timestamp' DESC) AS rn FROM ("
    "SELECT feature, 'timestamp' AS kind, CASE WHEN ms_share >= s_share THEN 'ms' ELSE 's' END AS best_unit, "
    "greatest(ms_share, s_share) AS share FROM sh WHERE feature IN ('shift_ts', 'shift_created_ms', 'delivered_ts', 'sale_date_text') "
    "AND numeric_share >= 0.8 AND greatest(ms_share, s_share) >= 0.8 UNION ALL "
    "SELECT feature, 'string_date', NULL, parse_share FROM sh WHERE pattern_share >= 0.5 AND parse_share >= 0.8)) "
    "WHERE rn = 1", l0=L, l=_SHIFT, sh=_share_sql(_EPOCH)))
def _date_candidates(spark, sf):
    return D.date_candidates(_shifted(spark, sf), _EPOCH)


@query("normalize_dates", with_cte(
    "SELECT lead_id, to_timestamp(sale_ts)::TIMESTAMP AS sale_dt2, "
    "epoch_ms(created_ms)::TIMESTAMP AS created_ms_dt, strptime(sale_date_text, '%Y-%m-%d') AS sale_date_text_dt, "
    "CASE WHEN lead_id % 6 = 0 THEN NULL ELSE to_timestamp(sale_ts)::TIMESTAMP END AS text_epoch_dt FROM l", l=L))
def _normalize_dates(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_ts", "created_ms", "sale_date_text", F.when(
        F.col("lead_id") % 6 == 0, "n/a").otherwise(F.col("sale_ts").cast("string")).alias("text_epoch"))
    out = D.normalize_dates(d, [("sale_ts", "s"), ("created_ms", "ms"), ("sale_date_text", None), ("text_epoch", "s")])
    return out.withColumnRenamed("sale_dt", "sale_dt2")


@query("parse_date_best", with_cte(
    "SELECT lead_id, epoch_ms(created_ms)::TIMESTAMP AS created_parsed, "
    "CASE WHEN lead_id % 6 = 0 THEN NULL ELSE strptime(sale_date_text, '%Y-%m-%d') END AS text_parsed, "
    "CASE WHEN lead_id % 6 = 0 THEN NULL ELSE epoch_ms(created_ms)::TIMESTAMP END AS epoch_parsed FROM l", l=L))
def _parse_best(spark, sf):
    junk = F.col("lead_id") % 6 == 0
    d = leads(spark, sf).select("lead_id", "created_ms", F.when(junk, "n/a").otherwise(F.col("sale_date_text")).alias("text"),
                                F.when(junk, "-").otherwise(F.col("created_ms").cast("string")).alias("epoch"))
    d = D.parse_date_best(d, "created_ms", "created_parsed")
    d = D.parse_date_best(d, "text", "text_parsed")
    return D.parse_date_best(d, "epoch", "epoch_parsed").select("lead_id", "created_parsed", "text_parsed", "epoch_parsed")


_DT = ["sale_dt", "created_dt", "delivered_dt"]
_DT_SQL = ("SELECT lead_id, sale_dt, epoch_ms(created_ms)::TIMESTAMP AS created_dt, "
           "CASE WHEN lead_id % 10 = 0 THEN NULL ELSE to_timestamp(delivered_ts)::TIMESTAMP END AS delivered_dt FROM l")


def _dts(spark, sf):
    d = leads(spark, sf)
    return d.select("lead_id", "sale_dt", F.timestamp_millis("created_ms").cast("timestamp_ntz").alias("created_dt"),
                    F.when(F.col("lead_id") % 10 == 0, None).otherwise(
                        F.timestamp_seconds("delivered_ts").cast("timestamp_ntz")).alias("delivered_dt"))


def _pair_sql():
    parts = []
    for a in _DT:
        for b in _DT:
            if a == b:
                continue
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER (WHERE {both}) AS n, "
                         f"count(*) FILTER (WHERE {both} AND {a} <= {b}) / count(*) FILTER (WHERE {both}) AS le_share, "
                         f"count(*) FILTER (WHERE {both} AND {a} < {b}) / count(*) FILTER (WHERE {both}) AS lt_share, "
                         f"count(*) FILTER (WHERE {both} AND {a} = {b}) / count(*) FILTER (WHERE {both}) AS eq_share FROM dt")
    return " UNION ALL ".join(parts)


@query("date_pair_stats", with_cte(
    'SELECT "left", "right", n, round(le_share, 6) AS le_share, round(lt_share, 6) AS lt_share, '
    f'round(eq_share, 6) AS eq_share FROM ({_pair_sql()}) WHERE n >= 30', l=L, dt=_DT_SQL))
def _pair_stats(spark, sf):
    st = D.date_pair_stats(_dts(spark, sf), _DT)
    return st.select("left", "right", "n", *[_r(F.col(c)).alias(c) for c in ("le_share", "lt_share", "eq_share")])


@query("date_order", with_cte(
    "SELECT feature, CAST(sum(v) AS BIGINT) AS order_score FROM (SELECT \"left\" AS feature, -1 AS v FROM ps "
    "WHERE le_share >= 0.8 UNION ALL SELECT \"right\", 1 FROM ps WHERE le_share >= 0.8) GROUP BY feature",
    l=L, dt=_DT_SQL, ps=f"SELECT * FROM ({_pair_sql()}) WHERE n >= 30"))
def _date_order(spark, sf):
    return D.date_order(D.date_pair_stats(_dts(spark, sf), _DT))


@query("calendar_parts", with_cte(
    "SELECT lead_id, CAST(coalesce(month(x), -1) AS INT) AS c_month, CAST(coalesce(quarter(x), -1) AS INT) AS c_quarter, "
    "CAST(coalesce(weekofyear(x), -1) AS INT) AS c_week, CAST(coalesce(isodow(x) - 1, -1) AS INT) AS c_weekday, "
    "coalesce(CAST(isodow(x) - 1 >= 5 AS INT), -1) AS c_weekend, CAST(coalesce(hour(x), -1) AS INT) AS c_hour, "
    "CAST(coalesce(day(x), -1) AS INT) AS c_day FROM (SELECT lead_id, CASE WHEN lead_id % 10 = 0 THEN NULL ELSE "
    "to_timestamp(delivered_ts + lead_id % 86400)::TIMESTAMP END AS x FROM l)", l=L))
def _calendar(spark, sf):
    d = leads(spark, sf).select("lead_id", F.when(F.col("lead_id") % 10 == 0, None).otherwise(
        F.timestamp_seconds(F.col("delivered_ts") + F.col("lead_id") % 86400).cast("timestamp_ntz")).alias("x"))
    parts = D.calendar_parts("x", "c")
    return d.select("lead_id", *[v.cast("int").alias(k) for k, v in parts.items()])


@query("expand_datetime_columns", with_cte(
    "SELECT lead_id, CAST(year(sale_dt) AS INT) AS sale_dt_year, CAST(month(sale_dt) AS INT) AS sale_dt_month, "
    "CAST(day(sale_dt) AS INT) AS sale_dt_day, CAST(isodow(sale_dt) - 1 AS INT) AS sale_dt_weekday, "
    "CAST(hour(sale_dt) AS INT) AS sale_dt_hour, amount FROM l", l=L))
def _expand_dt(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_dt", "amount")
    out = D.expand_datetime_columns(d)
    return out.select("lead_id", *[F.col(c).cast("int").alias(c) for c in out.columns if c.startswith("sale_dt_")],
                      "amount")


@query("cyclic_day", with_cte(
    "SELECT lead_id, round(coalesce(sin(2 * pi() * day(x) / 30.0), -1.0), 6) AS day_sin, "
    "round(coalesce(cos(2 * pi() * day(x) / 30.0), -1.0), 6) AS day_cos FROM "
    "(SELECT lead_id, CASE WHEN lead_id % 10 = 0 THEN NULL ELSE sale_dt END AS x FROM l)", l=L))
def _cyclic(spark, sf):
    d = leads(spark, sf).select("lead_id", F.when(F.col("lead_id") % 10 == 0, None).otherwise(F.col("sale_dt")).alias("x"))
    s, c = D.cyclic_day("x")
    return d.select("lead_id", _r(s).alias("day_sin"), _r(c).alias("day_cos"))


@query("date_range_filter", with_cte(
    "SELECT lead_id, sale_dt FROM l WHERE sale_dt >= TIMESTAMP '1996-03-01' AND sale_dt <= TIMESTAMP '1997-03-29'", l=L))
def _range(spark, sf):
    return D.date_range_filter(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "1996-03-01", "1997-03-29")


@query("date_out_of_range_to_null", with_cte(
    "SELECT lead_id, CASE WHEN sale_dt >= TIMESTAMP '1996-01-01' AND sale_dt <= TIMESTAMP '2000-12-31' "
    "THEN sale_dt END AS sale_dt FROM l", l=L))
def _oor(spark, sf):
    d = leads(spark, sf)
    return d.select("lead_id", D.date_out_of_range_to_null("sale_dt", "1996-01-01", "2000-12-31").alias("sale_dt"))


# ------------------------------------------------------------------ §2.4
@query("safe_binary_target", with_cte(
    "SELECT lead_id, CASE WHEN TRY_CAST(t AS DOUBLE) IN (0.0, 1.0) THEN TRY_CAST(t AS DOUBLE) "
    "WHEN lower(trim(t)) IN ('true', 'yes') THEN 1.0 WHEN lower(trim(t)) IN ('false', 'no') THEN 0.0 END AS y FROM "
    "(SELECT lead_id, CASE WHEN lead_id % 4 = 0 THEN CAST(buyout_flag AS STRING) WHEN lead_id % 4 = 1 THEN "
    "CASE WHEN buyout_flag = 1 THEN 'Yes' ELSE 'no' END WHEN lead_id % 4 = 2 THEN "
    "CASE WHEN buyout_flag = 1 THEN 'TRUE' ELSE 'false' END ELSE 'maybe' END AS t FROM l)", l=L))
def _safe_target(spark, sf):
    from tabsieve.functions.text import safe_binary_target
    d = leads(spark, sf).selectExpr(
        "lead_id", "CASE WHEN lead_id % 4 = 0 THEN CAST(buyout_flag AS STRING) WHEN lead_id % 4 = 1 THEN "
        "CASE WHEN buyout_flag = 1 THEN 'Yes' ELSE 'no' END WHEN lead_id % 4 = 2 THEN "
        "CASE WHEN buyout_flag = 1 THEN 'TRUE' ELSE 'false' END ELSE 'maybe' END AS t")
    return d.select("lead_id", safe_binary_target("t").alias("y"))


_NUMC = ["sale_ts", "created_ms", "delivered_ts", "amount", "price", "acctbal", "owner_a", "owner_b", "score"]


def _pearson_sql(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, xb = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    r = (f"CASE WHEN stddev_pop({xa}) * stddev_pop({xb}) = 0 THEN NULL ELSE "
         f"covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})) END")
    return r, f"count({xa})"


def _target_corr_sql():
    parts = []
    for c in _NUMC:
        r, n = _pearson_sql(c, "buyout_flag")
        parts.append(f"SELECT '{c}' AS feature, {r} AS corr, {n} AS n FROM l")
    return ("SELECT feature, round(corr, 4) AS corr, n FROM (" + " UNION ALL ".join(parts) +
            ") WHERE corr IS NOT NULL AND n >= 30 AND abs(corr) >= 0.0")


@query("numeric_target_corr", with_cte(_target_corr_sql(), l=L))
def _target_corr(spark, sf):
    d = leads(spark, sf).select(*_NUMC, "buyout_flag")
    return A.numeric_target_corr(d, "buyout_flag", _NUMC, min_abs=0.0)


def _feature_corr_sql():
    parts = []
    for i, a in enumerate(_NUMC):
        for b in _NUMC[i + 1:]:
            r, n = _pearson_sql(a, b)
            parts.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r} AS corr, {n} AS n FROM l")
    return ('SELECT "left", "right", round(corr, 4) AS corr, n FROM (' + " UNION ALL ".join(parts) +
            ") WHERE corr IS NOT NULL AND n >= 30 AND abs(corr) >= 0.8")


@query("numeric_feature_corr", with_cte(_feature_corr_sql(), l=L))
def _feature_corr(spark, sf):
    return A.numeric_feature_corr(leads(spark, sf).select(*_NUMC), _NUMC)


_CAT = ["priority", "status", "segment", "nation", "segment_near", "const_col", "cust_name"]


def _cramers_sql(cols, target="buyout_flag"):
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, NULLIF({d_norm(c)}, '') AS value, {target} AS y, count(*) AS o FROM l "
        f"WHERE NULLIF({d_norm(c)}, '') IS NOT NULL AND {target} IS NOT NULL GROUP BY 1, 2, 3" for c in cols)
    return f"""SELECT feature, CASE WHEN least(r, k) - 1 > 0 THEN sqrt(greatest(n * (s - 1) / n / (least(r, k) - 1), 0))
      ELSE 0.0 END AS cramers_v, n, r AS levels FROM (
      SELECT c.feature, sum(o * o / (rs * cs)) AS s, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT value) AS r,
             count(DISTINCT y) AS k
      FROM ({cells}) c
      JOIN (SELECT feature, value, sum(o) AS rs FROM ({cells}) GROUP BY feature, value) rr USING (feature, value)
      JOIN (SELECT feature, y, sum(o) AS cs FROM ({cells}) GROUP BY feature, y) cc USING (feature, y)
      GROUP BY c.feature)"""


@query("cramers_v", with_cte(
    f"SELECT feature, round(cramers_v, 6) AS cramers_v, n, levels FROM ({_cramers_sql(['segment'], 'priority_y')})",
    l0=L, l="SELECT segment, coalesce(priority, 'none') AS priority_y FROM l0"))
def _cramers(spark, sf):
    d = leads(spark, sf).select("segment", F.coalesce("priority", F.lit("none")).alias("priority_y"))
    return A.cramers_v(d, "segment", "priority_y").select("feature", _r(F.col("cramers_v")).alias("cramers_v"),
                                                        "n", "levels")


@query("categorical_target_assoc", with_cte(
    f"SELECT feature, round(cramers_v, 4) AS cramers_v, n, levels FROM ({_cramers_sql(_CAT)}) "
    "WHERE levels >= 2 AND levels <= 100 AND n >= 30 AND cramers_v >= 0.05", l=L))
def _cat_assoc(spark, sf):
    return A.categorical_target_assoc(leads(spark, sf).select(*_CAT, "buyout_flag"), "buyout_flag", _CAT)


@query("leak_screen", with_cte(
    "SELECT feature, 'target_corr' AS reason, abs(corr) AS strength FROM (" +
    _target_corr_sql().replace("abs(corr) >= 0.0", "abs(corr) >= 0.8") + ") UNION ALL "
    f"SELECT feature, 'target_assoc', round(cramers_v, 4) FROM ({_cramers_sql(_CAT)}) "
    "WHERE levels >= 2 AND levels <= 100 AND n >= 30 AND round(cramers_v, 4) >= 0.8 UNION ALL "
    "SELECT 'delivered_ts', 'known_leak', NULL", l=L))
def _leak(spark, sf):
    d = leads(spark, sf).select(*_CAT, *_NUMC, "buyout_flag")
    return A.leak_screen(d, "buyout_flag", known_leaks=["delivered_ts", "not_there"]).table


@query("univariate_auc", with_cte(
    "SELECT round(sum(pos * (cum_neg - 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM ("
    "SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM "
    "(SELECT acctbal AS s, sum(CAST(buyout_flag = 1 AS BIGINT)) AS pos, sum(CAST(buyout_flag <> 1 AS BIGINT)) AS neg "
    "FROM l WHERE acctbal IS NOT NULL GROUP BY acctbal))", l=L))
def _uni_auc(spark, sf):
    return V.roc_auc(leads(spark, sf), "buyout_flag", "acctbal").select(_r(F.col("roc_auc"), 9).alias("roc_auc"))


# ------------------------------------------------------------------ §2.7
@query("assemble_blocks", with_cte(
    "SELECT lead_id AS row_id, segment, nation, priority, amount, status FROM l", l=L))
def _assemble(spark, sf):
    d = leads(spark, sf).withColumnRenamed("lead_id", "row_id")
    base = f"blocks_{uuid.uuid4().hex}"
    blocks = [d.select("row_id", "segment", "nation"), d.select("row_id", "priority", "amount"), d.select("row_id", "status")]
    return J.assemble_stored(spark, [J.store_block(b, f"{base}_{i}", f"{checkpoint_dir(spark)}/{base}/{i}")
                                     for i, b in enumerate(blocks)])


@query("left_join_raw_columns", with_cte(
    "SELECT l.lead_id, l.amount, c_acctbal, c_mktsegment FROM l LEFT JOIN customer ON "
    "CASE WHEN lead_id % 7 = 0 THEN -contact_id ELSE contact_id END = c_custkey", l=L))
def _left_raw(spark, sf):
    # every seventh key is one that no customer has, so the left join keeps unmatched rows
    key = F.when(F.col("lead_id") % 7 == 0, -F.col("contact_id")).otherwise(F.col("contact_id")).alias("contact_id")
    d = leads(spark, sf).select("lead_id", "amount", key)
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("contact_id"), "c_acctbal", "c_mktsegment")
    return d.join(c, "contact_id", "left").drop("contact_id")


@query("left_join_history", with_cte(
    "SELECT lead_id, coalesce(n_lines, 0) AS n_lines, coalesce(qty, 0.0) AS qty FROM l LEFT JOIN "
    "(SELECT CASE WHEN l_orderkey % 7 = 0 THEN -l_orderkey ELSE l_orderkey END AS k, count(*) AS n_lines, "
    "sum(l_quantity) AS qty FROM lineitem GROUP BY k) h ON l.lead_id = h.k", l=L))
def _left_hist(spark, sf):
    d = leads(spark, sf).select("lead_id")
    # the history of every seventh order is under a key that no lead has
    key = F.when(F.col("l_orderkey") % 7 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    h = (read(spark, sf, "lineitem").groupBy(key.alias("lead_id"))
         .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty")))
    return J.left_join_fill(d, h, "lead_id", {"n_lines": 0, "qty": 0.0})


_RANK_SQL = {
    "lr": "SELECT p_brand AS feature, avg(p_retailprice) AS s FROM part GROUP BY p_brand",
    "rf": "SELECT p_brand AS feature, CAST(count(*) AS DOUBLE) AS s FROM part GROUP BY p_brand",
    "cb": "SELECT p_brand AS feature, CAST(max(p_size) AS DOUBLE) AS s FROM part GROUP BY p_brand",
}


def _rank_lists(spark, sf):
    p = read(spark, sf, "part")
    return {"lr": p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("s")),
            "rf": p.groupBy(F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("s")),
            "cb": p.groupBy(F.col("p_brand").alias("feature")).agg(F.max("p_size").cast("double").alias("s"))}


def _ranked_sql(name, k):
    return (f"SELECT feature, CAST(rk AS BIGINT) AS rank_{name}, ({k} - rk + 1) / {float(k)} AS score_{name}, "
            f"CAST(1 AS BIGINT) AS vote_{name} FROM (SELECT feature, row_number() OVER (ORDER BY s DESC, feature) AS rk "
            f"FROM ({_RANK_SQL[name]})) WHERE rk <= {k}")


@query("outer_join_rankings",
       "SELECT coalesce(a.feature, b.feature, c.feature) AS feature, rank_lr, rank_rf, rank_cb FROM "
       f"({_ranked_sql('lr', 10)}) a FULL JOIN ({_ranked_sql('rf', 10)}) b ON a.feature = b.feature "
       f"FULL JOIN ({_ranked_sql('cb', 10)}) c ON coalesce(a.feature, b.feature) = c.feature")
def _outer(spark, sf):
    lists = _rank_lists(spark, sf)
    ranked = {k: O.rank_scores(v, "feature", "s", 10, k).select("feature", f"rank_{k}") for k, v in lists.items()}
    return J.outer_join_rankings(ranked)


@query("lookup_region_by_prefix", with_cte(
    "SELECT lead_id, coalesce(v, 'unknown') AS region FROM (SELECT lead_id, upper(substr(nation, 1, 3)) AS pfx FROM l) x "
    "LEFT JOIN (SELECT pfx, arg_max(r_name, ord) AS v FROM (SELECT upper(substr(n_name, 1, 3)) AS pfx, r_name, "
    "n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY pfx) d ON x.pfx = d.pfx", l=L))
def _prefix(spark, sf):
    d = leads(spark, sf).select("lead_id", F.upper(F.substring("nation", 1, 3)).alias("pfx"))
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    ref = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.upper(F.substring("n_name", 1, 3)).alias("pfx"), "r_name", F.col("n_nationkey").alias("ord"))
    return J.lookup_by_prefix(d, "pfx", ref, "pfx", "r_name", "ord", "region").select("lead_id", "region")


def _city_sql():
    norm = lambda c: rf"lower(trim(regexp_replace(regexp_replace({c}, '\d{{6}}', '', 'g'), '[\s,]+', ' ', 'g')))"
    ref = ("SELECT r_name AS region, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey")
    return with_cte(
        "SELECT lead_id, m.mapped AS region_out FROM c LEFT JOIN m ON c.city = m.v",
        l=L, ref=ref,
        c="SELECT lead_id, CASE WHEN lead_id % 4 = 0 THEN nation WHEN lead_id % 4 = 1 THEN '123456 ' || lower(nation) "
          "|| ', ctr' WHEN lead_id % 4 = 2 THEN 'somewhere' ELSE NULL END AS city FROM l",
        v=f"SELECT DISTINCT city AS v, {norm('city')} AS vn FROM c WHERE city IS NOT NULL",
        rg=f"SELECT DISTINCT region AS r, {norm('region')} AS rn FROM ref",
        ct=f"SELECT city AS cc, min(region) AS cr, {norm('city')} AS cn FROM ref GROUP BY city",
        m1="SELECT v, r AS m1 FROM v JOIN rg ON v.v = rg.r",
        m2="SELECT v, cr AS m2 FROM v JOIN ct ON v.v = ct.cc",
        m3="SELECT v, r AS m3 FROM (SELECT v, r, row_number() OVER (PARTITION BY v ORDER BY length(rn) DESC, r DESC) "
           "AS k FROM v JOIN rg ON contains(vn, rn) AND length(rn) > 0) WHERE k = 1",
        m4="SELECT v, cr AS m4 FROM (SELECT v, cr, row_number() OVER (PARTITION BY v ORDER BY length(cn) DESC, cc DESC) "
           "AS k FROM v JOIN ct ON contains(vn, cn) AND length(cn) > 0) WHERE k = 1",
        m="SELECT v.v, coalesce(m1, m2, m3, m4, v.v) AS mapped FROM v LEFT JOIN m1 USING (v) LEFT JOIN m2 USING (v) "
          "LEFT JOIN m3 USING (v) LEFT JOIN m4 USING (v)")


@query("map_city_to_region", _city_sql())
def _city_region(spark, sf):
    d = leads(spark, sf).selectExpr(
        "lead_id", "CASE WHEN lead_id % 4 = 0 THEN nation WHEN lead_id % 4 = 1 THEN '123456 ' || lower(nation) || ', ctr' "
        "WHEN lead_id % 4 = 2 THEN 'somewhere' ELSE NULL END AS city")
    ref = load_reference_table(spark, sf)
    return J.map_city_to_region(d, "city", ref, "region", ref, "city", "region", "region_out").select(
        "lead_id", "region_out")


# ------------------------------------------------------------------ §2.8
@query("global_row_id", with_cte(
    "SELECT lead_id, row_number() OVER (ORDER BY sale_dt, lead_id) - 1 AS row_id FROM l", l=L))
def _grid(spark, sf):
    return O.global_index(leads(spark, sf).select("lead_id", "sale_dt"), ["sale_dt", "lead_id"], "row_id").select(
        "lead_id", "row_id")


@query("lag_n", with_cte(
    "SELECT lead_id, lag(buyout_flag, 30) OVER w AS lag_30, lag(buyout_flag, 60) OVER w AS lag_60 FROM l "
    "WINDOW w AS (ORDER BY sale_dt, lead_id)", l=L))
def _lag(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_dt", "buyout_flag")
    return O.lag_rows(d, ["sale_dt", "lead_id"], "buyout_flag").select("lead_id", "lag_30", "lag_60")


@query("rolling_mean_30", with_cte(
    "SELECT lead_id, round(avg(buyout_flag) OVER (ORDER BY sale_dt, lead_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 9) "
    "AS roll30 FROM l", l=L))
def _roll(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_dt", "buyout_flag")
    out = O.rolling_mean(d, ["sale_dt", "lead_id"], "buyout_flag", 30, out="roll30", bucket_rows=4096)
    return out.select("lead_id", _r(F.col("roll30"), 9).alias("roll30"))


@query("customer_history", with_cte(
    "SELECT lead_id, round(coalesce(sum(greatest(coalesce(amount, 0), 0)) OVER w, 0), 4) AS spend_before, "
    "count(*) OVER w AS past_orders, CAST(count(*) OVER w > 0 AS INT) AS is_repeat FROM l "
    "WINDOW w AS (PARTITION BY contact_id ORDER BY sale_dt, lead_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    l=L))
def _history(spark, sf):
    d = leads(spark, sf).select("lead_id", "contact_id", "sale_dt", "amount")
    out = O.customer_history(d, "contact_id", "sale_dt", "lead_id", "amount", block_rows=512)
    return out.select("lead_id", _r(F.col("spend_before"), 4).alias("spend_before"), "past_orders", "is_repeat")


@query("rank_scores", _ranked_sql("lr", 10))
def _rank_scores(spark, sf):
    return O.rank_scores(_rank_lists(spark, sf)["lr"], "feature", "s", 10, "lr")


@query("dedupe_keep_best", with_cte(
    "SELECT contact_id, lead_id, amount FROM (SELECT contact_id, lead_id, amount, row_number() OVER "
    "(PARTITION BY contact_id ORDER BY amount DESC, lead_id) AS rn FROM l) WHERE rn = 1", l=L))
def _dedupe(spark, sf):
    d = leads(spark, sf).select("contact_id", "lead_id", "amount")
    return O.dedupe_keep_best(d, "contact_id", [F.desc("amount"), F.asc("lead_id")])


# ------------------------------------------------------------------ §2.9
@query("group_sum_max_count",
       "SELECT p_type AS base_feature, round(sum(p_retailprice), 4) AS sum_abs, max(p_retailprice) AS max_abs, "
       "count(*) AS nonzero_count FROM part WHERE p_retailprice <> 0 GROUP BY p_type")
def _gsmc(spark, sf):
    p = read(spark, sf, "part").where(F.col("p_retailprice") != 0)
    return p.groupBy(F.col("p_type").alias("base_feature")).agg(
        _r(F.sum("p_retailprice"), 4).alias("sum_abs"), F.max("p_retailprice").alias("max_abs"),
        F.count(F.lit(1)).alias("nonzero_count"))


@query("top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def _top_n(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(
        F.desc("p_retailprice"), "p_partkey").limit(25)


@query("sort_by_time", with_cte("SELECT lead_id, sale_dt FROM l ORDER BY sale_dt, lead_id", l=L))
def _sort(spark, sf):
    return leads(spark, sf).select("lead_id", "sale_dt").orderBy("sale_dt", "lead_id")


@query("distinct_rows", with_cte("SELECT DISTINCT segment, nation FROM l", l=L))
def _distinct(spark, sf):
    return leads(spark, sf).select("segment", "nation").distinct()


@query("backfill_union",
       "SELECT feature FROM (SELECT feature, votes, score FROM (SELECT feature, CAST(count(*) AS BIGINT) AS votes, "
       "sum(sc) AS score FROM (SELECT feature, score_lr AS sc FROM (" + _ranked_sql("lr", 8) + ") UNION ALL "
       "SELECT feature, score_rf FROM (" + _ranked_sql("rf", 8) + ") UNION ALL SELECT feature, score_cb FROM (" +
       _ranked_sql("cb", 8) + ")) GROUP BY feature) ORDER BY votes >= 2 DESC, votes DESC, score DESC, feature LIMIT 12)")
def _backfill(spark, sf):
    lists = _rank_lists(spark, sf)
    parts = [O.rank_scores(v, "feature", "s", 8, k).select("feature", F.col(f"score_{k}").alias("sc"))
             for k, v in lists.items()]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    agg = u.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"), F.sum("sc").alias("score"))
    return (agg.orderBy(F.desc(F.col("votes") >= 2), F.desc("votes"), F.desc("score"), "feature")
            .limit(12).select("feature"))


_DAILY_SQL = ("SELECT d AS day, coalesce(m, 0.0) AS value FROM (SELECT CAST(unnest(generate_series("
              "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), "
              "INTERVAL 1 DAY)) AS DATE) AS d) s LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS dd, "
              "avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS m FROM orders GROUP BY dd) a ON s.d = a.dd")


@query("daily_resample_mean", f"SELECT day, round(value, 9) AS value FROM ({_DAILY_SQL})")
def _daily(spark, sf):
    o = read(spark, sf, "orders").select("o_orderdate", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    out = O.daily_resample_mean(o, "o_orderdate", "y")
    return out.select("day", _r(F.col("value"), 9).alias("value"))


def _decomp_sql(p):
    h = p // 2
    ma = (f"(sum(value) OVER (ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) - 0.5 * "
          f"(lag(value, {h}) OVER (ORDER BY i) + lead(value, {h}) OVER (ORDER BY i))) / {p}")
    return with_cte(
        "SELECT day, round(value, 9) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, "
        "round(value - trend - seasonal, 6) AS resid FROM t JOIN (SELECT ph, pm - avg(pm) OVER () AS seasonal FROM "
        "(SELECT ph, coalesce(avg(value - trend), 0.0) AS pm FROM t GROUP BY ph)) s USING (ph)",
        dd=_DAILY_SQL,
        t=f"SELECT day, value, i % {p} AS ph, CASE WHEN lag(value, {h}) OVER (ORDER BY i) IS NOT NULL AND "
          f"lead(value, {h}) OVER (ORDER BY i) IS NOT NULL THEN {ma} END AS trend FROM "
          f"(SELECT day, value, CAST(day - (SELECT min(day) FROM dd) AS BIGINT) AS i FROM dd)")


@query("seasonal_decompose", _decomp_sql(30))
def _decomp(spark, sf):
    o = read(spark, sf, "orders").select("o_orderdate", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    daily = O.daily_resample_mean(o, "o_orderdate", "y")
    out = O.seasonal_decompose(daily, "day", "value", 30)
    return out.select("day", _r(F.col("value"), 9).alias("value"), *[_r(F.col(c)).alias(c) for c in ("trend", "seasonal", "resid")])


# ------------------------------------------------------------------ §2.10
# some rows have no score (as out-of-fold scores do) and some no label
_SCORES = ("SELECT lead_id, sale_dt, CASE WHEN lead_id % 17 = 0 THEN NULL ELSE buyout_flag END AS y, "
           "CASE WHEN lead_id % 13 = 0 THEN NULL ELSE score END AS p0, "
           "CASE WHEN lead_id % 13 = 0 THEN NULL ELSE 1 - score END AS p1 FROM l")


def _scored(spark, sf):
    p0 = F.when(F.col("lead_id") % 13 != 0, F.col("score"))
    return leads(spark, sf).select("lead_id", "sale_dt", F.when(F.col("lead_id") % 17 != 0, F.col("buyout_flag")).alias("y"),
                                   p0.alias("p0"), (1 - p0).alias("p1"))


@query("time_split", with_cte(
    "SELECT lead_id, CASE WHEN row_number() OVER (ORDER BY sale_dt, lead_id) - 1 < "
    "CAST(floor((SELECT count(*) FROM l) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM l", l=L))
def _tsplit(spark, sf):
    return V.time_split(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "lead_id").select("lead_id", "split")


@query("time_split_val", with_cte(
    "SELECT lead_id, CASE WHEN rn < CAST(floor(CAST(floor(n * 0.8) AS BIGINT) * 0.9) AS BIGINT) THEN 'train' "
    "WHEN rn < CAST(floor(n * 0.8) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM "
    "(SELECT lead_id, row_number() OVER (ORDER BY sale_dt, lead_id) - 1 AS rn, (SELECT count(*) FROM l) AS n FROM l)", l=L))
def _tsplitv(spark, sf):
    return V.time_split_val(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "lead_id").select("lead_id", "split")


def _folds_sql(k):
    return with_cte(
        "SELECT CAST(f AS BIGINT) AS fold, min(rn) AS n_train, count(*) AS n_test, min(sale_dt) AS test_min_time, "
        "max(sale_dt) AS test_max_time FROM (SELECT *, " + " ".join(
            f"CASE WHEN rn >= n - {k - i} * (n // {k + 1}) AND rn < n - {k - i - 1} * (n // {k + 1}) THEN {i} ELSE"
            for i in range(k)) + " NULL" + " END" * k + " AS f FROM (SELECT sale_dt, row_number() OVER "
        "(ORDER BY sale_dt, lead_id) - 1 AS rn, (SELECT count(*) FROM l) AS n FROM l)) WHERE f IS NOT NULL GROUP BY f",
        l=L)


@query("expanding_folds", _folds_sql(5))
def _efolds(spark, sf):
    f = V.expanding_folds(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "lead_id", 5)
    return V.fold_summary(f, "sale_dt", 5)


@query("expanding_folds_blocks", with_cte(
    "SELECT CAST(b AS BIGINT) AS fold, min(rn) AS n_train, count(*) AS n_test, min(sale_dt) AS test_min_time, "
    "max(sale_dt) AS test_max_time FROM (SELECT sale_dt, rn, least(rn // (n // 5), 4) AS b FROM (SELECT sale_dt, "
    "row_number() OVER (ORDER BY sale_dt, lead_id) - 1 AS rn, (SELECT count(*) FROM l) AS n FROM l)) WHERE b >= 1 GROUP BY b",
    l=L))
def _bfolds(spark, sf):
    f = V.expanding_folds_blocks(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "lead_id", 5)
    return V.fold_summary(f, "sale_dt", 5)


_POS = ("SELECT lead_id, buyout_flag, row_number() OVER (PARTITION BY buyout_flag ORDER BY lead_id) - 1 AS pos, "
        "count(*) OVER (PARTITION BY buyout_flag) AS n FROM l")


@query("stratified_split", with_cte(
    "SELECT lead_id, buyout_flag, CASE WHEN pos < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM p",
    l=L, p=_POS))
def _strat(spark, sf):
    d = leads(spark, sf).select("lead_id", "buyout_flag")
    return V.stratified_split(d, "buyout_flag", "lead_id", shuffle=False).select("lead_id", "buyout_flag", "split")


@query("stratified_kfold", with_cte(
    "SELECT lead_id, buyout_flag, CAST(pos % 5 AS INT) AS fold FROM p", l=L, p=_POS))
def _skfold(spark, sf):
    d = leads(spark, sf).select("lead_id", "buyout_flag")
    return V.stratified_kfold(d, "buyout_flag", "lead_id", 5, shuffle=False).select("lead_id", "buyout_flag", "fold")


_LAB = ("CASE WHEN p0 >= 0.15 AND y = 0 THEN 'tp_0' WHEN p0 < 0.15 AND y = 0 THEN 'fn_0' "
        "WHEN p0 >= 0.15 AND y = 1 THEN 'fp_0' WHEN p0 < 0.15 AND y = 1 THEN 'tn_0' ELSE 'unknown' END")


@query("confusion_labels", with_cte(
    f"SELECT lead_id, CASE WHEN p0 >= 0.15 THEN 0 WHEN p0 < 0.15 THEN 1 END AS pred_label, {_LAB} AS error_type FROM s",
    l=L, s=_SCORES))
def _clabels(spark, sf):
    return V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15).select("lead_id", "pred_label", "error_type")


@query("confusion_summary", with_cte(
    "SELECT 'threshold' AS metric, 0.15 AS value UNION ALL SELECT 'total', CAST(count(*) AS DOUBLE) FROM s UNION ALL " +
    " UNION ALL ".join(f"SELECT '{t}', CAST(count(*) FILTER (WHERE {_LAB} = '{t}') AS DOUBLE) FROM s"
                       for t in ("tp_0", "fn_0", "fp_0", "tn_0")), l=L, s=_SCORES))
def _csummary(spark, sf):
    return V.confusion_summary(V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15), 0.15)


@query("split_time_ranges", with_cte(
    "SELECT split, min(sale_dt) AS min_time, max(sale_dt) AS max_time, count(*) AS rows FROM (SELECT sale_dt, "
    "CASE WHEN row_number() OVER (ORDER BY sale_dt, lead_id) - 1 < CAST(floor((SELECT count(*) FROM l) * 0.8) AS BIGINT) "
    "THEN 'train' ELSE 'test' END AS split FROM l) GROUP BY split", l=L))
def _ranges(spark, sf):
    s = V.time_split(leads(spark, sf).select("lead_id", "sale_dt"), "sale_dt", "lead_id")
    return V.split_time_ranges(s, "split", "sale_dt")


@query("confusion_matrix", with_cte(
    "SELECT g.y_true, g.y_pred, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) "
    "t(y_true, y_pred)) g LEFT JOIN (SELECT y AS y_true, CASE WHEN p0 >= 0.15 THEN 0 WHEN p0 < 0.15 THEN 1 END AS y_pred, count(*) AS n "
    "FROM s GROUP BY ALL) c USING (y_true, y_pred)", l=L, s=_SCORES))
def _cmatrix(spark, sf):
    lab = V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15)
    return V.confusion_matrix(lab, "y", "pred_label")


def _counts_sql():
    return ("SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE y = {a} AND pr = {b}) AS DOUBLE) AS c{a}{b}"
                                  for a in (0, 1) for b in (0, 1)) +
            " FROM (SELECT y, CASE WHEN p0 >= 0.15 THEN 0 WHEN p0 < 0.15 THEN 1 END AS pr FROM s)")


def _pr_sql(k):
    o = 1 - k
    p = f"coalesce(c{k}{k} / nullif(c{k}{k} + c{o}{k}, 0), 0.0)"
    r = f"coalesce(c{k}{k} / nullif(c{k}{k} + c{k}{o}, 0), 0.0)"
    return p, r


def _f(p, r, b):
    b2 = b * b
    return f"coalesce((1 + {b2}) * {p} * {r} / nullif({b2} * {p} + {r}, 0), 0.0)"


@query("class_metrics", with_cte(
    "SELECT " + ", ".join(f"round({_pr_sql(k)[0]}, 9) AS precision_{k}, round({_pr_sql(k)[1]}, 9) AS recall_{k}, "
                          f"round({_f(*_pr_sql(k), 1)}, 9) AS f1_{k}, round({_f(*_pr_sql(k), 2)}, 9) AS f2_{k}"
                          for k in (0, 1)) + " FROM c", l=L, s=_SCORES, c=_counts_sql()))
def _cmetrics(spark, sf):
    lab = V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15)
    m = V.class_metrics(lab, "y", "pred_label")
    return m.select(*[_r(F.col(c), 9).alias(c) for c in m.columns])


@query("f_beta", with_cte(
    f"SELECT round({_f(*_pr_sql(0), 1)}, 9) AS f1_0, round({_f(*_pr_sql(0), 2)}, 9) AS f2_0, "
    f"round({_f(*_pr_sql(1), 2)}, 9) AS f2_1 FROM c", l=L, s=_SCORES, c=_counts_sql()))
def _fbeta(spark, sf):
    lab = V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15)
    m = V.class_metrics(lab, "y", "pred_label")
    return m.select(*[_r(F.col(c), 9).alias(c) for c in ("f1_0", "f2_0", "f2_1")])


def _report_sql():
    p0, r0 = _pr_sql(0)
    p1, r1 = _pr_sql(1)
    f0, f1 = _f(p0, r0, 1), _f(p1, r1, 1)
    s0, s1 = "(c00 + c01)", "(c10 + c11)"
    sup = f"({s0} + {s1})"
    w = lambda a, b: f"coalesce(({a} * {s0} + {b} * {s1}) / nullif({sup}, 0), 0.0)"
    acc = f"coalesce((c00 + c11) / nullif({sup}, 0), 0.0)"
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", sup),
            ("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), sup), ("accuracy", acc, acc, acc, sup)]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS label, round({a}, 9) AS precision, round({b}, 9) AS recall, round({c}, 9) AS f1, "
        f"CAST({d} AS DOUBLE) AS support FROM c" for n, a, b, c, d in rows)


@query("classification_report", with_cte(_report_sql(), l=L, s=_SCORES, c=_counts_sql()))
def _creport(spark, sf):
    lab = V.confusion_labels(_scored(spark, sf), "y", "p0", 0.15)
    r = V.classification_report(lab, "y", "pred_label")
    return r.select("label", *[_r(F.col(c), 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("roc_auc", with_cte(
    "SELECT round(sum(pos * (cum_neg - 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM (SELECT pos, neg, "
    "sum(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM (SELECT p0 AS sc, "
    "sum(CAST(y = 0 AS BIGINT)) AS pos, sum(CAST(y <> 0 AS BIGINT)) AS neg FROM s WHERE p0 IS NOT NULL GROUP BY p0))", l=L, s=_SCORES))
def _auc(spark, sf):
    return V.roc_auc(_scored(spark, sf), "y", "p0", positive=0).select(_r(F.col("roc_auc"), 9).alias("roc_auc"))


@query("average_precision", with_cte(
    "SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 9) AS average_precision FROM (SELECT pos, "
    "sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM (SELECT p0 AS sc, sum(CAST(y = 0 AS BIGINT)) AS pos, "
    "sum(CAST(y <> 0 AS BIGINT)) AS neg FROM s WHERE p0 IS NOT NULL GROUP BY p0) WINDOW w AS (ORDER BY sc DESC ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW))", l=L, s=_SCORES))
def _ap(spark, sf):
    return V.average_precision(_scored(spark, sf), "y", "p0", positive=0).select(
        _r(F.col("average_precision"), 9).alias("average_precision"))


@query("log_loss", with_cte(
    "SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss FROM (SELECT y, least(greatest(p1, "
    "2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM s WHERE p1 IS NOT NULL)", l=L, s=_SCORES))
def _logloss(spark, sf):
    return V.log_loss(_scored(spark, sf), "y", "p1").select(_r(F.col("log_loss"), 9).alias("log_loss"))


def _thr_sql():
    grid = " UNION ALL ".join(f"SELECT {i} AS i, CAST(0.05 AS DOUBLE) + CAST({i} AS DOUBLE) * CAST(0.01 AS DOUBLE) "
                              "AS threshold" for i in range(91))
    tp = "count(*) FILTER (WHERE y = 0 AND p0 >= threshold)"
    fp = "count(*) FILTER (WHERE y = 1 AND p0 >= threshold)"
    return (f"SELECT threshold, tp AS tp_0, n0 - tp AS fn_0, fp AS fp_0, n1 - fp AS tn_0 FROM (SELECT threshold, "
            f"(SELECT {tp} FROM s) AS tp, (SELECT {fp} FROM s) AS fp, (SELECT count(*) FILTER (WHERE y = 0 AND p0 IS NOT NULL) FROM s) AS n0, "
            f"(SELECT count(*) FILTER (WHERE y = 1 AND p0 IS NOT NULL) FROM s) AS n1 FROM ({grid}))")


@query("threshold_table", with_cte(
    "SELECT threshold, tp_0, fn_0, fp_0, tn_0, round(coalesce(tp_0 / nullif(tp_0 + fp_0, 0), 0.0), 9) AS precision_0, "
    "round(coalesce(tp_0 / nullif(tp_0 + fn_0, 0), 0.0), 9) AS recall_0 FROM tt", l=L, s=_SCORES, tt=_thr_sql()))
def _thr(spark, sf):
    t = V.threshold_table(_scored(spark, sf), "y", "p0")
    return t.select("threshold", "tp_0", "fn_0", "fp_0", "tn_0", _r(F.col("precision_0"), 9).alias("precision_0"),
                    _r(F.col("recall_0"), 9).alias("recall_0"))


@query("threshold_best_f1", with_cte(
    "SELECT threshold FROM (SELECT threshold, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM (SELECT threshold, "
    "coalesce(tp_0 / nullif(tp_0 + fp_0, 0), 0.0) AS p, coalesce(tp_0 / nullif(tp_0 + fn_0, 0), 0.0) AS r FROM tt)) "
    "ORDER BY f1 DESC, threshold LIMIT 1", l=L, s=_SCORES, tt=_thr_sql()))
def _best_f1(spark, sf):
    return V.threshold_best_f1(V.threshold_table(_scored(spark, sf), "y", "p0")).select("threshold")


@query("threshold_constrained", with_cte(
    "SELECT threshold FROM (SELECT threshold, 0 AS pri, p AS key FROM m WHERE r >= 0.5 AND p1 >= 0.5 UNION ALL "
    "SELECT threshold, 1, 0.5 * r + 0.5 * p FROM m) ORDER BY pri, key DESC, threshold LIMIT 1",
    l=L, s=_SCORES, tt=_thr_sql(),
    m="SELECT threshold, coalesce(tp_0 / nullif(tp_0 + fp_0, 0), 0.0) AS p, "
      "coalesce(tp_0 / nullif(tp_0 + fn_0, 0), 0.0) AS r, coalesce(tn_0 / nullif(tn_0 + fn_0, 0), 0.0) AS p1 FROM tt"))
def _constrained(spark, sf):
    t = V.threshold_table(_scored(spark, sf), "y", "p0")
    return V.threshold_constrained(t, min_recall_0=0.5, min_precision_1=0.5).select("threshold")


