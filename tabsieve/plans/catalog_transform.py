"""Catalogued queries: numeric transforms (§2.5) and categorical/text operators (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions import rules as R
from tabsieve.functions import text as X
from tabsieve.operators import encode as E
from tabsieve.operators import transform as T
from tabsieve.plans.inputs import leads, leads_sql, lines, lines_sql, read, with_cte
from tabsieve.plans.registry import query

L = leads_sql()
LN = lines_sql()


def _r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- §2.5
@query("missing_flag", with_cte(
    "SELECT lead_id, CAST(price IS NULL AS INT) AS price_missing, "
    "CAST(priority IS NULL AS INT) AS priority_missing FROM l", l=L))
def _missing_flag(spark, sf):
    d = leads(spark, sf)
    return d.select("lead_id", T.missing_flag("price").alias("price_missing"),
                    T.missing_flag("priority").alias("priority_missing"))


@query("known_flag", with_cte(
    "SELECT lead_id, CAST(owner_b IS NOT NULL AS INT) AS owner_known FROM l", l=L))
def _known_flag(spark, sf):
    return leads(spark, sf).select("lead_id", T.known_flag("owner_b").alias("owner_known"))


@query("placeholder_to_null", with_cte(
    "SELECT lead_id, CASE WHEN coalesce(priority IN ('5-LOW', '{campaing_id}'), false) THEN NULL "
    "ELSE priority END AS priority_clean FROM l", l=L))
def _placeholder(spark, sf):
    return leads(spark, sf).select(
        "lead_id", X.placeholder_to_null("priority", ["5-LOW", "{campaing_id}"]).alias("priority_clean"))


@query("fill_constant", with_cte(
    "SELECT lead_id, coalesce(price, -1.0) AS price_filled, coalesce(priority, 'unknown') AS priority_filled, "
    "coalesce(owner_b, -1) AS owner_filled FROM l", l=L))
def _fill_constant(spark, sf):
    return leads(spark, sf).select(
        "lead_id", T.fill_constant("price", -1.0).alias("price_filled"),
        T.fill_constant("priority", "unknown").alias("priority_filled"),
        T.fill_constant("owner_b", -1).alias("owner_filled"))


@query("fill_median", with_cte(
    "SELECT lead_id, coalesce(price, (SELECT median(price) FROM l WHERE sale_dt < TIMESTAMP '1998-01-01')) "
    "AS price FROM l", l=L))
def _fill_median(spark, sf):
    d = leads(spark, sf)
    train = d.where(F.col("sale_dt") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return T.fill_median(d.select("lead_id", "price"), ["price"], fit_df=train)


@query("coerce_features", with_cte(
    "SELECT lead_id, coalesce(priority, 'missing') AS priority, coalesce(segment, 'missing') AS segment, "
    "CAST(price AS DOUBLE) AS price, CAST(owner_b AS DOUBLE) AS owner_b FROM l", l=L))
def _coerce(spark, sf):
    d = leads(spark, sf).select("lead_id", "priority", "segment", "price", "owner_b")
    out = T.coerce_features(d, categorical=["priority", "segment"])
    return out.withColumn("lead_id", F.col("lead_id").cast("bigint"))


@query("fill_mode", with_cte(
    "SELECT lead_id, coalesce(priority, (SELECT v FROM (SELECT priority AS v, count(*) AS n FROM l "
    "WHERE priority IS NOT NULL GROUP BY priority ORDER BY n DESC, v LIMIT 1))) AS priority FROM l", l=L))
def _fill_mode(spark, sf):
    return E.fill_mode(leads(spark, sf).select("lead_id", "priority"), "priority")


_LOC = ("CASE WHEN lead_id % 5 = 0 THEN '-' WHEN lead_id % 5 = 1 THEN ' ' "
        "WHEN lead_id % 5 = 2 THEN CAST(CAST(floor(amount) AS BIGINT) AS STRING) || ',' || "
        "lpad(CAST(CAST(floor(amount * 100) AS BIGINT) % 100 AS STRING), 2, '0') "
        "WHEN lead_id % 5 = 3 THEN 'n/a' ELSE CAST(CAST(floor(amount) AS BIGINT) AS STRING) || '.' || "
        "lpad(CAST(CAST(floor(amount * 100) AS BIGINT) % 100 AS STRING), 2, '0') END")


@query("parse_localised_number", with_cte(
    "SELECT lead_id, round(TRY_CAST(replace(CASE WHEN trim(raw) IN ('-', '') THEN NULL ELSE trim(raw) END, ',', '.') "
    "AS DOUBLE), 6) AS cost FROM (SELECT lead_id, " + _LOC + " AS raw FROM l)", l=L))
def _parse_num(spark, sf):
    d = leads(spark, sf).selectExpr("lead_id", f"{_LOC} AS raw")
    return d.select("lead_id", _r6(T.parse_localised_number("raw")).alias("cost"))


@query("log1p_nonnegative", with_cte(
    "SELECT lead_id, round(coalesce(CASE WHEN d >= 0 THEN ln(1 + d) END, -1.0), 6) AS delay_log FROM "
    "(SELECT lead_id, CAST(delivered_ts - sale_ts AS DOUBLE) / 86400.0 AS d FROM l)", l=L))
def _log1p(spark, sf):
    d = leads(spark, sf).select("lead_id", ((F.col("delivered_ts") - F.col("sale_ts")).cast("double")
                                            / 86400.0).alias("d"))
    return d.select("lead_id", _r6(T.log1p_nonnegative("d", fill=-1.0)).alias("delay_log"))


_Q = ("(SELECT quantile_cont(acctbal, 0.25) AS q1, quantile_cont(acctbal, 0.5) AS q2, "
      "quantile_cont(acctbal, 0.75) AS q3 FROM l)")


@query("iqr_outlier_to_median", with_cte(
    "SELECT lead_id, round(CASE WHEN acctbal < q1 - 1.5 * (q3 - q1) OR acctbal > q3 + 1.5 * (q3 - q1) "
    f"THEN q2 ELSE acctbal END, 6) AS acctbal FROM l, {_Q} qq", l=L))
def _iqr_median(spark, sf):
    d = leads(spark, sf).select("lead_id", (F.col("acctbal") * F.when(F.col("lead_id") % 97 == 0, 50)
                                            .otherwise(1)).alias("acctbal"))
    out = T.iqr_outlier_to_median(d, "acctbal")
    return out.select("lead_id", _r6(F.col("acctbal")).alias("acctbal"))


_iqr_median_sql = with_cte(
    "SELECT lead_id, round(CASE WHEN acctbal < q1 - 1.5 * (q3 - q1) OR acctbal > q3 + 1.5 * (q3 - q1) "
    f"THEN q2 ELSE acctbal END, 6) AS acctbal FROM l2, "
    "(SELECT quantile_cont(acctbal, 0.25) AS q1, quantile_cont(acctbal, 0.5) AS q2, "
    "quantile_cont(acctbal, 0.75) AS q3 FROM l2) qq",
    l=L, l2="SELECT lead_id, acctbal * CASE WHEN lead_id % 97 = 0 THEN 50 ELSE 1 END AS acctbal FROM l")
from tabsieve.plans.registry import ORACLES  # noqa: E402
ORACLES["iqr_outlier_to_median"] = _iqr_median_sql


@query("iqr_clip_upper", with_cte(
    "SELECT lead_id, round(CASE WHEN amount IS NULL THEN NULL ELSE least(amount, q3 + 2 * (q3 - q1)) END, 6) "
    "AS amount FROM l, (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM l) qq",
    l=L))
def _iqr_clip(spark, sf):
    d = leads(spark, sf).select("lead_id", "amount")
    return T.iqr_clip_upper(d, "amount").select("lead_id", _r6(F.col("amount")).alias("amount"))


@query("clip", with_cte(
    "SELECT lead_id, CASE WHEN d IS NULL THEN NULL ELSE least(greatest(d, 0), 30) END AS d_clipped FROM "
    "(SELECT lead_id, CASE WHEN lead_id % 10 = 0 THEN NULL ELSE (delivered_ts - sale_ts) // 86400 * 4 END AS d FROM l)",
    l=L))
def _clip(spark, sf):
    d = leads(spark, sf).select("lead_id", F.when(F.col("lead_id") % 10 == 0, None).otherwise(
        F.expr("(delivered_ts - sale_ts) div 86400 * 4")).alias("d"))
    return d.select("lead_id", T.clip("d", lower=0, upper=30).alias("d_clipped"))


@query("bin_by_rules", with_cte(
    "SELECT lead_id, CASE WHEN width IS NULL THEN 'unknown' WHEN width < 10 OR width > 50 THEN 'anomaly' "
    "WHEN width < 25 THEN 'small' WHEN width <= 35 THEN 'normal' ELSE 'large' END AS width_cat, "
    "CASE WHEN height IS NULL THEN 'unknown' WHEN height <= 4 THEN 'small' WHEN height <= 12 THEN 'medium' "
    "ELSE 'large' END AS height_bin FROM ln", ln=LN))
def _bins(spark, sf):
    d = lines(spark, sf)
    return d.select("lead_id", R.width_category("width").alias("width_cat"),
                    R.height_bin("height").alias("height_bin"))


def _qbin_sql():
    e = "(SELECT " + ", ".join(f"quantile_cont(price, {i / 5}) AS e{i}" for i in range(6)) + " FROM l) ee"
    case = "CASE WHEN price IS NULL THEN NULL WHEN price >= e0 AND price <= e1 THEN 0 " + " ".join(
        f"WHEN price > e{i} AND price <= e{i + 1} THEN {i}" for i in range(1, 5)) + " END"
    return with_cte(f"SELECT lead_id, {case} AS price_bin FROM l, {e}", l=L)


@query("quantile_bins", _qbin_sql())
def _qbins(spark, sf):
    d = leads(spark, sf).select("lead_id", "price")
    return T.quantile_bins(d, "price", "price_bin", q=5).select("lead_id", "price_bin")


@query("above_median_flag", with_cte(
    "SELECT lead_id, CAST(coalesce(amount > (SELECT median(amount) FROM l), false) AS INT) AS amount_high FROM l",
    l=L))
def _above_median(spark, sf):
    d = leads(spark, sf).select("lead_id", "amount")
    return T.above_median_flag(d, "amount", "amount_high").select("lead_id", "amount_high")


@query("ratio_features", with_cte(
    "SELECT lead_id, price / (quantity + 1) AS price_per_unit, "
    "CAST(coalesce(price > 3230 AND price <= 7290, false) AS INT) AS price_band FROM ln", ln=LN))
def _ratio(spark, sf):
    d = lines(spark, sf)
    return d.select("lead_id", T.ratio("price", "quantity").alias("price_per_unit"),
                    T.band_flag("price", 3230, 7290).alias("price_band"))


@query("interaction_flags", with_cte(
    "SELECT lead_id, CAST(price IS NULL AS INT) * buyout_flag AS missing_x_target, "
    "CAST(coalesce(segment IN ('BUILDING', 'MACHINERY'), false) AS INT) AS seg_member, "
    "CAST(coalesce(status = 'F', false) AS INT) * CAST(coalesce(priority = '1-URGENT', false) AS INT) AS urgent_f "
    "FROM l", l=L))
def _interactions(spark, sf):
    d = leads(spark, sf)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return d.select("lead_id",
                    (T.missing_flag("price") * F.col("buyout_flag")).alias("missing_x_target"),
                    flag(F.col("segment").isin("BUILDING", "MACHINERY")).alias("seg_member"),
                    (flag(F.col("status") == "F") * flag(F.col("priority") == "1-URGENT")).alias("urgent_f"))


@query("delay_days", with_cte(
    "SELECT lead_id, CAST(d IS NULL AS INT) AS deliv_missing, round(coalesce(ln(1 + d), -1.0), 6) AS deliv_log FROM "
    "(SELECT lead_id, CASE WHEN (delivered_ts - sale_ts) / 86400.0 >= 0 THEN (delivered_ts - sale_ts) / 86400.0 END "
    "AS d FROM l)", l=L))
def _delay(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_ts", "delivered_ts")
    out = T.delay_days_features(d, "sale_ts", "delivered_ts", "deliv")
    return out.select("lead_id", "deliv_missing", _r6(F.col("deliv_log")).alias("deliv_log"))


@query("capped_delay", with_cte(
    "SELECT lead_id, CAST(dv IS NOT NULL AS INT) AS asm_flag, CAST(coalesce(d > 30, false) AS INT) AS asm_long, "
    "round(CASE WHEN d IS NULL THEN -1.0 ELSE least(d, 30.0) END, 6) AS asm_days FROM (SELECT lead_id, dv, "
    "(dv - sale_ts) / 86400.0 * 4 + 1 AS d FROM (SELECT lead_id, sale_ts, "
    "CASE WHEN lead_id % 8 = 0 THEN NULL ELSE delivered_ts END AS dv FROM l))", l=L))
def _capped(spark, sf):
    d = leads(spark, sf).select("lead_id", "sale_ts", F.when(F.col("lead_id") % 8 == 0, None)
                                .otherwise(F.col("delivered_ts")).alias("dv"))
    d = d.withColumn("dv4", F.col("sale_ts") + (F.col("dv") - F.col("sale_ts")) * 4)
    out = T.capped_delay(d.withColumn("dv", F.col("dv")), "sale_ts", "dv4", "asm")
    out = out.withColumn("asm_flag", F.col("dv").isNotNull().cast("int"))
    return out.select("lead_id", "asm_flag", "asm_long", _r6(F.col("asm_days")).alias("asm_days"))


@query("delta_seconds", with_cte(
    "SELECT lead_id, CAST(sale_ts * 1000 - created_ms AS DOUBLE) / 1000.0 AS delta_s, "
    "round(greatest(CAST(delivered_ts - sale_ts AS DOUBLE) / 3600.0, 0.0), 6) AS delta_h FROM l", l=L))
def _delta(spark, sf):
    d = leads(spark, sf)
    return d.select("lead_id",
                    (T.delta_seconds(F.col("sale_ts") * 1000, "created_ms") / 1000.0).alias("delta_s"),
                    _r6(T.delta_hours_floor0("delivered_ts", "sale_ts")).alias("delta_h"))


# ----------------------------------------------------------------- §2.6
@query("map_values", with_cte(
    "SELECT lead_id, CASE WHEN priority IS NULL THEN 'none' WHEN priority = '1-URGENT' THEN 'hot' "
    "WHEN priority = '2-HIGH' THEN 'hot' WHEN priority = '3-MEDIUM' THEN 'warm' ELSE 'cold' END AS prio_class FROM l",
    l=L))
def _map_values(spark, sf):
    d = leads(spark, sf)
    m = X.map_values("priority", {"1-URGENT": "hot", "2-HIGH": "hot", "3-MEDIUM": "warm"}, default="cold")
    return d.select("lead_id", F.when(F.col("priority").isNull(), "none").otherwise(m).alias("prio_class"))


@query("whitelist_group", with_cte(
    "SELECT lead_id, CASE WHEN coalesce(priority IN ('1-URGENT', '2-HIGH'), false) THEN priority ELSE 'other' END "
    "AS prio_group FROM l", l=L))
def _whitelist(spark, sf):
    return leads(spark, sf).select("lead_id", X.whitelist_group("priority", ["1-URGENT", "2-HIGH"]).alias("prio_group"))


@query("top_k_group_excl_unknown", with_cte(
    "SELECT lead_id, CASE WHEN p IN (SELECT v FROM top) OR p = 'unknown' THEN p ELSE 'rare' END AS prio_top FROM l2",
    l=L, l2="SELECT lead_id, coalesce(priority, 'unknown') AS p FROM l",
    top="SELECT v FROM (SELECT p AS v, count(*) AS n FROM l2 WHERE p <> 'unknown' GROUP BY p "
        "ORDER BY n DESC, v LIMIT 2)"))
def _topk_excl(spark, sf):
    d = leads(spark, sf).select("lead_id", F.coalesce("priority", F.lit("unknown")).alias("p"))
    out = E.top_k_group(d, "p", 2, out="prio_top", other="rare", exclude_from_ranking=["unknown"])
    return out.select("lead_id", "prio_top")


@query("rare_by_min_count", with_cte(
    "SELECT lead_id, CASE WHEN n < 10 THEN 'OTHER' ELSE name END AS name_grouped FROM "
    "(SELECT lead_id, cust_name AS name, count(*) OVER (PARTITION BY cust_name) AS n FROM l)", l=L))
def _rare(spark, sf):
    d = leads(spark, sf).select("lead_id", F.col("cust_name").alias("name"))
    return E.rare_by_min_count(d, "name", 10, out="name_grouped").select("lead_id", "name_grouped")


@query("rank_tier", with_cte(
    "SELECT lead_id, CASE WHEN rk <= 5 THEN 'top' WHEN rk <= 10 THEN 'middle' ELSE 'rare' END AS contact_tier "
    "FROM l LEFT JOIN (SELECT contact_id AS cid, row_number() OVER (ORDER BY n DESC, contact_id) AS rk FROM "
    "(SELECT contact_id, count(*) AS n FROM l GROUP BY contact_id)) r ON l.contact_id = r.cid", l=L))
def _rank_tier(spark, sf):
    d = leads(spark, sf).select("lead_id", "contact_id")
    return E.rank_tier(d, "contact_id", "contact_tier").select("lead_id", "contact_tier")


@query("frequency_encode", with_cte(
    "SELECT lead_id, round(CAST(count(*) OVER (PARTITION BY coalesce(priority, 'unknown')) AS DOUBLE) / "
    "count(*) OVER (), 6) AS prio_freq FROM l", l=L))
def _freq(spark, sf):
    d = leads(spark, sf).select("lead_id", "priority")
    return E.frequency_encode(d, "priority", "prio_freq").select("lead_id", _r6(F.col("prio_freq")).alias("prio_freq"))


_SPLIT = "TIMESTAMP '1998-01-01'"


@query("frequency_encode_train_test", with_cte(
    "SELECT lead_id, round(coalesce(f, 0.0), 6) AS name_freq FROM (SELECT * FROM l WHERE sale_dt >= " + _SPLIT + ") t "
    "LEFT JOIN (SELECT cust_name AS v, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l WHERE sale_dt < " + _SPLIT +
    ") AS f FROM l WHERE sale_dt < " + _SPLIT + " GROUP BY cust_name) s ON t.cust_name = s.v", l=L))
def _freq_tt(spark, sf):
    d = leads(spark, sf).select("lead_id", "cust_name", "sale_dt")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    st = E.frequency_encode_fit(d.where(F.col("sale_dt") < cut), "cust_name")
    out = E.frequency_encode_apply(d.where(F.col("sale_dt") >= cut), st, "name_freq")
    return out.select("lead_id", _r6(F.col("name_freq")).alias("name_freq"))


@query("target_mean_encode", with_cte(
    "SELECT lead_id, round(avg(CAST(buyout_flag AS DOUBLE)) OVER (PARTITION BY nation), 6) AS nation_te FROM l", l=L))
def _te(spark, sf):
    d = leads(spark, sf).select("lead_id", "nation", "buyout_flag")
    return E.target_mean_encode(d, "nation", "buyout_flag", "nation_te").select(
        "lead_id", _r6(F.col("nation_te")).alias("nation_te"))


@query("oof_target_encode", with_cte(
    "SELECT l.lead_id, round(coalesce(CASE WHEN tn - coalesce(fn, 0) > 0 THEN (ts - coalesce(fs, 0)) / (tn - coalesce(fn, 0)) END, "
    "(SELECT avg(CAST(buyout_flag AS DOUBLE)) FROM l)), 6) AS name_oof FROM l "
    "LEFT JOIN (SELECT cust_name AS v, sum(buyout_flag) AS ts, count(buyout_flag) AS tn FROM l GROUP BY cust_name) t "
    "ON l.cust_name = t.v LEFT JOIN (SELECT cust_name AS v2, lead_id % 5 AS f, sum(buyout_flag) AS fs, "
    "count(buyout_flag) AS fn FROM l GROUP BY cust_name, lead_id % 5) ff ON l.cust_name = ff.v2 AND l.lead_id % 5 = ff.f",
    l=L))
def _oof(spark, sf):
    d = leads(spark, sf).select("lead_id", "cust_name", "buyout_flag")
    out = E.oof_target_encode(d, "cust_name", "buyout_flag", "name_oof", fold=F.pmod("lead_id", F.lit(5)), k=5)
    return out.select("lead_id", _r6(F.col("name_oof")).alias("name_oof"))


@query("loo_group_mean", with_cte(
    "SELECT lead_id, round(CASE WHEN n - 1 > 0 THEN (s - amount) / (n - 1) END, 6) AS contact_loo FROM "
    "(SELECT lead_id, amount, sum(amount) OVER (PARTITION BY contact_id) AS s, "
    "count(amount) OVER (PARTITION BY contact_id) AS n FROM l)", l=L))
def _loo(spark, sf):
    d = leads(spark, sf).select("lead_id", "contact_id", "amount")
    out = E.loo_group_mean(d, "contact_id", "amount", "contact_loo")
    return out.select("lead_id", _r6(F.col("contact_loo")).alias("contact_loo"))


@query("lower_trim_norm", with_cte(
    "SELECT lead_id, lower(trim(coalesce(priority, 'UNKNOWN'))) AS prio_norm FROM l", l=L))
def _ltn(spark, sf):
    return leads(spark, sf).select("lead_id", X.lower_trim_norm("priority").alias("prio_norm"))


_DOC_RE = "été|über|año|the quick|privacy"


@query("regex_flag",
       f"SELECT doc_id, CAST(coalesce(regexp_matches(text, '(?i)({_DOC_RE})'), false) AS INT) AS has_kw FROM documents")
def _regex_flag(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", X.regex_flag("text", f"({_DOC_RE})").alias("has_kw"))


_KW = [("ring", "jewel"), ("widget", "gadget"), ("bolt", "hardware"), ("red", "colour")]


@query("first_keyword_category",
       "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in _KW) +
       " ELSE 'other' END AS name_cat FROM part")
def _first_kw(spark, sf):
    d = read(spark, sf, "part")
    return d.select("p_partkey", X.first_keyword_category("p_name", _KW).alias("name_cat"))


@query("url_site_category",
       "SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'unknown' WHEN contains(lower(url), 'spam') THEN 'spam' "
       "WHEN contains(lower(url), 'blog') THEN 'blog' ELSE 'other' END AS site_cat FROM pages")
def _site_cat(spark, sf):
    d = read(spark, sf, "pages")
    cat = X.first_keyword_category("url", [("spam", "spam"), ("blog", "blog")])
    return d.select("page_id", F.when(F.col("url").isNull() | (F.col("url") == ""), "unknown")
                    .otherwise(cat).alias("site_cat"))


@query("url_last_segment",
       "SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS last_seg FROM pages")
def _last_seg(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.url_last_segment("url").alias("last_seg"))


_HOST_S = "regexp_extract(url, '://([^/?#]+)', 1)"


def _site_family_sql():
    x = "h"
    for label, contains, pre, suf, inf in R.SITE_FAMILIES:
        cond = f"(starts_with({x}, '{pre}') OR ends_with({x}, '{suf}') OR contains({x}, '{inf}')"
        cond += f" OR contains({x}, '{contains}'))" if contains else ")"
        x = f"(CASE WHEN coalesce({cond}, false) THEN '{label}' ELSE {x} END)"
    return f"SELECT page_id, {x} AS site_family FROM (SELECT page_id, {_HOST_S} AS h FROM pages)"


@query("site_family", _site_family_sql())
def _site_family(spark, sf):
    d = read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("h"))
    return d.select("page_id", R.site_family("h").alias("site_family"))


@query("leading_letters",
       "SELECT c_custkey, CASE WHEN regexp_extract(coalesce(c_name, ''), '^[A-Za-zА-Яа-яЁё]+', 0) = '' THEN 'unknown' "
       "ELSE regexp_extract(coalesce(c_name, ''), '^[A-Za-zА-Яа-яЁё]+', 0) END AS name_head FROM customer")
def _leading(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", X.leading_letters("c_name").alias("name_head"))


_UTM = ("CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat_ws('_', CAST(page_id AS STRING), "
        "CASE WHEN page_id % 3 = 0 THEN 'ab' ELSE CAST(page_id % 10 AS STRING) END, "
        "CASE WHEN page_id % 5 = 0 THEN 'x1f' ELSE CAST(page_id * 3 AS STRING) END, 'p4', "
        "CASE WHEN page_id % 7 = 0 THEN 'undefined' WHEN page_id % 7 = 1 THEN '' ELSE 'mobile' END, "
        "'p6', 'p7', 'p8', 'p9', CASE WHEN page_id % 6 = 0 THEN 'p10_extra' ELSE 'p10' END) END")


def _utm_parts_sql(k):
    parts = "string_split(coalesce(u, 'None'), '_')"
    return f"CASE WHEN len({parts}) = 10 THEN {parts}[{k}] ELSE 'unknown' END"


@query("split_utm_content",
       "SELECT page_id, " + ", ".join(f"{_utm_parts_sql(k)} AS utm_{k}" for k in range(1, 11)) +
       f" FROM (SELECT page_id, {_UTM} AS u FROM pages)")
def _split_utm(spark, sf):
    d = read(spark, sf, "pages").selectExpr("page_id", f"{_UTM} AS u")
    p = R.utm_parts("u")
    return d.select("page_id", *[F.element_at(p, k).alias(f"utm_{k}") for k in range(1, 11)])


def _utm_id_sql(k):
    v = f"TRY_CAST({_utm_parts_sql(k)} AS DOUBLE)"
    return f"coalesce(CASE WHEN {v} = floor({v}) THEN CAST({v} AS BIGINT) END, -1)"


@query("utm_ids_and_device",
       f"SELECT page_id, CASE WHEN {_utm_parts_sql(5)} IN ('undefined', '') THEN 'unknown' ELSE {_utm_parts_sql(5)} END "
       f"AS utm_device_type, {_utm_id_sql(1)} AS utm_id_1, {_utm_id_sql(3)} AS utm_id_3 "
       f"FROM (SELECT page_id, {_UTM} AS u FROM pages)")
def _utm_ids(spark, sf):
    d = read(spark, sf, "pages").selectExpr("page_id", f"{_UTM} AS u")
    return d.select("page_id", R.utm_device("u").alias("utm_device_type"),
                    R.utm_id("u", 1).alias("utm_id_1"), R.utm_id("u", 3).alias("utm_id_3"))


@query("concat_key", with_cte(
    "SELECT lead_id, concat_ws('__', coalesce(segment, ''), coalesce(priority, ''), coalesce(nation, '')) AS combo FROM l",
    l=L))
def _concat_key(spark, sf):
    return leads(spark, sf).select("lead_id", X.concat_key("segment", "priority", "nation").alias("combo"))


_PICK = "CASE WHEN lead_id % 6 = 0 THEN 'no code here' ELSE 'pvz ' || upper(substr(nation, 1, 3)) || CAST(owner_a AS STRING) || ' city' END"


@query("pickup_code_extract", with_cte(
    f"SELECT lead_id, CASE WHEN regexp_extract(coalesce(t, ''), '[A-Z]+\\d+', 0) = '' THEN 'unknown' "
    f"ELSE regexp_extract(coalesce(t, ''), '[A-Z]+\\d+', 0) END AS pickup_code FROM (SELECT lead_id, {_PICK} AS t FROM l)",
    l=L))
def _pickup(spark, sf):
    d = leads(spark, sf).selectExpr("lead_id", f"{_PICK} AS t")
    return d.select("lead_id", X.pickup_code_extract("t").alias("pickup_code"))


_CODE = "CASE WHEN lead_id % 5 = 0 THEN 'x' || CAST(owner_a AS STRING) ELSE upper(substr(nation, 1, 2)) || CAST(owner_a AS STRING) END"


@query("code_prefix", with_cte(
    f"SELECT lead_id, CASE WHEN regexp_extract(trim(coalesce(c, '')), '^([A-Z]+)\\d+$', 1) = '' THEN 'unknown' "
    f"ELSE regexp_extract(trim(coalesce(c, '')), '^([A-Z]+)\\d+$', 1) END AS code_prefix FROM (SELECT lead_id, {_CODE} AS c FROM l)",
    l=L))
def _code_prefix(spark, sf):
    d = leads(spark, sf).selectExpr("lead_id", f"{_CODE} AS c")
    return d.select("lead_id", X.code_prefix("c").alias("code_prefix"))


@query("explode_cities",
       "SELECT DISTINCT r_name AS region, trim(city) AS city FROM (SELECT r_name, unnest(string_split(cities, ',')) AS city "
       "FROM (SELECT r_name, string_agg(n_name, ', ') AS cities FROM nation JOIN region ON n_regionkey = r_regionkey "
       "GROUP BY r_name)) WHERE trim(city) <> ''")
def _explode(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    lists = (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name")
             .agg(F.concat_ws(", ", F.collect_list("n_name")).alias("cities")))  # 25-row fixed dimension
    from tabsieve.operators.joins import explode_cities
    return explode_cities(lists, "cities", keep=["r_name"]).withColumnRenamed("r_name", "region")


@query("same_owner_flag", with_cte(
    "SELECT lead_id, CAST(coalesce(owner_a = owner_b, false) OR owner_b IS NULL AS INT) AS same_owner FROM l", l=L))
def _same_owner(spark, sf):
    return leads(spark, sf).select("lead_id", X.same_owner_flag("owner_a", "owner_b").alias("same_owner"))


@query("ordinal_encode", with_cte(
    "SELECT lead_id, coalesce(code, -1) AS nation_code FROM (SELECT * FROM l WHERE sale_dt >= " + _SPLIT + ") t "
    "LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(nation, 'missing') AS v "
    "FROM l WHERE sale_dt < " + _SPLIT + ")) s ON coalesce(CASE WHEN lead_id % 9 = 0 THEN nation || '?' ELSE nation END, "
    "'missing') = s.v", l=L))
def _ordinal(spark, sf):
    d = leads(spark, sf).select("lead_id", "nation", "sale_dt")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    st = E.ordinal_encode_fit(d.where(F.col("sale_dt") < cut), "nation")
    # some later rows carry a level that the fit has not seen
    later = d.where(F.col("sale_dt") >= cut).withColumn("nation", F.when(
        F.col("lead_id") % 9 == 0, F.concat("nation", F.lit("?"))).otherwise(F.col("nation")))
    return E.ordinal_encode_apply(later, st, "nation_code").select("lead_id", "nation_code")


@query("standard_scale", with_cte(
    "SELECT lead_id, round((amount - (SELECT avg(amount) FROM l)) / (SELECT stddev_pop(amount) FROM l), 6) AS amount, "
    "round((acctbal - (SELECT avg(acctbal) FROM l)) / (SELECT stddev_pop(acctbal) FROM l), 6) AS acctbal FROM l", l=L))
def _scale(spark, sf):
    d = leads(spark, sf).select("lead_id", "amount", "acctbal")
    out = T.standard_scale(d, ["amount", "acctbal"])
    return out.select("lead_id", _r6(F.col("amount")).alias("amount"), _r6(F.col("acctbal")).alias("acctbal"))


@query("has_value_flags", with_cte(
    "SELECT lead_id, CAST(coalesce(p <> 'unknown', false) AS INT) AS has_priority, "
    "CAST(coalesce(segment = 'AUTOMOBILE', false) AS INT) AS is_auto FROM "
    "(SELECT lead_id, segment, coalesce(priority, 'unknown') AS p FROM l)", l=L))
def _has_value(spark, sf):
    d = leads(spark, sf).select("lead_id", "segment", F.coalesce("priority", F.lit("unknown")).alias("p"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return d.select("lead_id", flag(F.col("p") != "unknown").alias("has_priority"),
                    flag(F.col("segment") == "AUTOMOBILE").alias("is_auto"))


def _onehot_sql():
    parts = []
    for c in ("segment", "priority"):
        parts.append(f"coalesce(CAST((SELECT rk FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rk FROM "
                     f"(SELECT DISTINCT {c} AS v FROM l WHERE {c} IS NOT NULL)) WHERE v = l.{c}) AS INT), -1) "
                     f"AS {c}_slot")
        parts.append(f"CAST((SELECT count(DISTINCT {c}) FROM l) AS INT) AS {c}_size")
    return with_cte("SELECT lead_id, " + ", ".join(parts) + " FROM l", l=L)


@query("onehot_encode", _onehot_sql())
def _onehot(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from tabsieve.operators.models import onehot_encode
    d = leads(spark, sf).select("lead_id", "segment", "priority")
    out = onehot_encode(d, ["segment", "priority"])
    # the one-hot vectors, read back as (active slot, vector size); unseen/NULL -> all zeros -> -1
    cols = []
    for c in ("segment", "priority"):
        arr = vector_to_array(F.col(f"{c}_ohe"))
        cols += [(F.array_position(arr, F.lit(1.0)).cast("int") - 1).alias(f"{c}_slot"),
                 F.size(arr).cast("int").alias(f"{c}_size")]
    return out.select("lead_id", *cols)
