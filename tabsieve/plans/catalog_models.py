"""Catalogued queries: model training, selection and scoring (§2.11), error analysis (§2.12),
streaming reuse (§2.13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsieve.operators import errors as ER
from tabsieve.operators import evaluate as V
from tabsieve.operators import models as M
from tabsieve.operators import ordered as O
from tabsieve.operators import select as S
from tabsieve.plans import pipeline as PL
from tabsieve.plans.inputs import leads, leads_sql, read, with_cte
from tabsieve.plans.registry import query
from tabsieve.session import checkpoint_dir

L = leads_sql()

# lineitem with a planted signal: label from discount and quantity plus a hash-like noise term
ML_COLUMNS = [
    # (order, line, part, supplier, ship day) is the unique row key of lineitem
    ("lead_id", "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
                "CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))"),
    ("ship_dt", "l_shipdate"),
    ("quantity", "l_quantity"),
    ("price", "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END"),
    ("discount", "l_discount"),
    ("tax", "l_tax"),
    ("status", "l_linestatus"),
    ("flag", "l_returnflag"),
    ("y", "CAST(l_discount * 10 + l_quantity / 25.0 + ((l_orderkey * 7919 + l_linenumber * 104729) % 100) / 100.0 > 1.9 AS INT)"),
]
ML_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in ML_COLUMNS) + " FROM lineitem"
NUM = ["quantity", "price", "discount", "tax"]
CAT = ["status", "flag"]
TIME = ["ship_dt", "lead_id"]
# Settings of the registered fits. They are small so that every key can be run for each check; the operators take
# any size (the reference's own runs use 2,000 iterations and 10-25 tuning trials).
GBT_ITER, GBT_DEPTH, RF_TREES, QUICK_ITER, QUICK_DEPTH, TRIALS = 8, 4, 10, 4, 3, 2
SMALL_GBT = dict(maxIter=GBT_ITER, maxDepth=GBT_DEPTH, stepSize=0.2)


def ml_table(spark, sf):
    """The same rows as ``ML_SQL``; hundredths are divided as doubles, which gives the same value as a decimal division."""
    return read(spark, sf, "lineitem").selectExpr(*[f"{e.replace('/ 100.0', '/ 100.0D')} AS {a}" for a, e in ML_COLUMNS])


def _split(spark, sf):
    return V.time_split(ml_table(spark, sf), "ship_dt", "lead_id", 0.2)


@query("class_weights", with_cte(
    "SELECT y, (SELECT count(*) FROM m) / (2.0 * count(*)) AS weight, count(*) AS n FROM m GROUP BY y", m=ML_SQL))
def _class_weights(spark, sf):
    d = V.class_weight_column(ml_table(spark, sf), "y", "balanced")
    return d.groupBy("y").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("ordered_target_encode", with_cte(
    "SELECT lead_id, round((coalesce(sum(y) OVER w, 0) + (SELECT avg(y) FROM m)) / (count(*) OVER w + 1.0), 9) AS part_ts, "
    "round((coalesce(sum(y) OVER v, 0) + (SELECT avg(y) FROM m)) / (count(*) OVER v + 1.0), 9) AS flag_ts "
    "FROM m "
    "WINDOW w AS (PARTITION BY l_partkey ORDER BY ship_dt, lead_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "v AS (PARTITION BY flag ORDER BY ship_dt, lead_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    m=ML_SQL.replace(" FROM lineitem", ", l_partkey FROM lineitem")))
def _ordered_target(spark, sf):
    """A category with as many levels as parts, and one of three levels, by the same path."""
    from tabsieve.operators.encode import ordered_target_encode
    rows = read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {a}" for a, e in ML_COLUMNS], "l_partkey")
    out = ordered_target_encode(rows, "l_partkey", "y", "part_ts", TIME, block_rows=4096)
    out = ordered_target_encode(out, "flag", "y", "flag_ts", TIME, block_rows=4096)
    return out.select("lead_id", *[F.round(c, 9).alias(c) for c in ("part_ts", "flag_ts")])


@query("fit_boosted_trees", None)
def _fit_gbt(spark, sf):
    s = V.time_split_val(ml_table(spark, sf), "ship_dt", "lead_id")  # train / val / test by time
    trval = s.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    wt = V.class_weight_column(trval, "y", "fixed", {0: 5.0, 1: 1.0})
    fm = M.fit_boosted_trees(wt, "y", NUM, CAT, weight="weight", max_iter=GBT_ITER, depth=GBT_DEPTH, val_col="is_val",
                             order_by=TIME)
    return M.score_rows(fm, s.where("split = 'test'"), "lead_id", cls=0)


@query("fit_random_forest", None)
def _fit_rf(spark, sf):
    s = _split(spark, sf)
    fm = M.fit_random_forest(s.where("split = 'train'"), "y", NUM, CAT, n_trees=RF_TREES, depth=GBT_DEPTH, order_by=TIME)
    return M.score_rows(fm, s.where("split = 'test'"), "lead_id", cls=0)


@query("fit_elastic_net", None)
def _fit_en(spark, sf):
    s = _split(spark, sf)
    fm = M.fit_elastic_net(s.where("split = 'train'"), "y", NUM, CAT, C=1.0, l1_ratio=0.5)
    return M.score_rows(fm, s.where("split = 'test'"), "lead_id", cls=0)


@query("feature_importance", None)
def _importance(spark, sf):
    s = _split(spark, sf)
    train = s.where("split = 'train'")
    fm = M.fit_random_forest(train, "y", NUM, CAT, n_trees=RF_TREES, depth=GBT_DEPTH, order_by=TIME)
    return M.feature_importance(fm, train)


@query("fold_onehot_to_base", None)
def _fold_onehot(spark, sf):
    s = _split(spark, sf)
    train = s.where("split = 'train'")
    fm = M.fit_elastic_net(train, "y", NUM, CAT, C=10.0, l1_ratio=0.2)
    return M.coefficient_rollup(fm, train)


@query("select_by_importance", None)
def _select_top(spark, sf):
    s = _split(spark, sf)
    train = s.where("split = 'train'")
    fm = M.fit_boosted_trees(train, "y", NUM, CAT, max_iter=GBT_ITER, depth=GBT_DEPTH, order_by=TIME)
    imp = M.feature_importance(fm, train)
    return imp.orderBy(F.desc("importance"), "feature").limit(4)


@query("tune_params", None)
def _tune(spark, sf):
    f = V.expanding_folds(ml_table(spark, sf), "ship_dt", "lead_id", 2)
    return M.tune_params(f, "y", NUM, CAT, {"maxDepth": [2, 3, 4], "maxIter": [4, 6]}, n_trials=TRIALS)


@query("oof_scores", None)
def _oof_scores(spark, sf):
    f = V.expanding_folds(ml_table(spark, sf), "ship_dt", "lead_id", 3)
    out = M.oof_scores(f, "y", NUM, CAT, params=SMALL_GBT)
    return out.select("lead_id", "test_fold", "oof_p")


@query("drop_one_ablation", None)
def _ablation(spark, sf):
    s = _split(spark, sf)
    return M.drop_one_ablation(s.where("split = 'train'"), s.where("split = 'test'"), "y", NUM, CAT,
                               params=dict(maxIter=QUICK_ITER, maxDepth=QUICK_DEPTH))


@query("tail_pruning", None)
def _tail(spark, sf):
    s = _split(spark, sf)
    train = s.where("split = 'train'")
    imp = M.feature_importance(M.fit_random_forest(train, "y", NUM, CAT, n_trees=RF_TREES, depth=GBT_DEPTH, order_by=TIME), train)
    ranked = [r["feature"] for r in imp.orderBy(F.desc("importance"), "feature").collect()]  # one row per feature
    return M.tail_pruning(train, s.where("split = 'test'"), "y", ranked, NUM, CAT,
                          sizes=[3, 2, 1], params=dict(maxIter=QUICK_ITER, maxDepth=QUICK_DEPTH))


@query("score_rows", None)
def _score(spark, sf):
    s = _split(spark, sf)
    fm = M.fit_boosted_trees(s.where("split = 'train'"), "y", NUM, CAT, max_iter=GBT_ITER, depth=QUICK_DEPTH, order_by=TIME)
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    M.save_model(fm, path)
    unlabelled = s.where("split = 'test'").drop("y")
    return M.score_rows(M.load_model(path), unlabelled, "lead_id", cls=0)


@query("score_output", None)
def _score_output(spark, sf):
    from tabsieve.sources.io import score_output
    s = _split(spark, sf)
    fm = M.fit_random_forest(s.where("split = 'train'"), "y", NUM, CAT, n_trees=5, depth=3)
    return score_output(fm.transform(s.where("split = 'test'")), "lead_id", index=1)


# ---------------------------------------------------------------- selection
_RANK = {
    "lr": "SELECT p_brand AS feature, avg(p_retailprice) AS s FROM part GROUP BY p_brand",
    "rf": "SELECT p_brand AS feature, CAST(count(*) AS DOUBLE) AS s FROM part GROUP BY p_brand",
    "cb": "SELECT p_brand AS feature, CAST(max(p_size) AS DOUBLE) AS s FROM part GROUP BY p_brand",
}
_W = {"lr": 40.0, "rf": 10.0, "cb": 50.0}


def _rankings(spark, sf):
    p = read(spark, sf, "part")
    return {"lr": (p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("s")), "feature", "s"),
            "rf": (p.groupBy(F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("s")),
                   "feature", "s"),
            "cb": (p.groupBy(F.col("p_brand").alias("feature")).agg(F.max("p_size").cast("double").alias("s")),
                   "feature", "s")}


def _voting_sql(k, n, min_votes=2):
    def ranked(name):
        return (f"SELECT feature, rk AS rank_{name}, ({k} - rk + 1) / {float(k)} AS score_{name}, 1 AS vote_{name} "
                f"FROM (SELECT feature, row_number() OVER (ORDER BY s DESC, feature) AS rk FROM ({_RANK[name]})) "
                f"WHERE rk <= {k}")
    j = (f"SELECT coalesce(a.feature, b.feature, c.feature) AS feature, coalesce(score_lr, 0) AS score_lr, "
         f"coalesce(score_rf, 0) AS score_rf, coalesce(score_cb, 0) AS score_cb, coalesce(vote_lr, 0) + "
         f"coalesce(vote_rf, 0) + coalesce(vote_cb, 0) AS votes FROM ({ranked('lr')}) a FULL JOIN ({ranked('rf')}) b "
         f"ON a.feature = b.feature FULL JOIN ({ranked('cb')}) c ON coalesce(a.feature, b.feature) = c.feature")
    return (f"SELECT feature, CAST(votes AS BIGINT) AS votes, round(40.0 * score_lr + 10.0 * score_rf + 50.0 * score_cb, 9) "
            f"AS final_score, CAST(votes >= {min_votes} AS INT) AS selected FROM ({j}) "
            f"ORDER BY votes DESC, 40.0 * score_lr + 10.0 * score_rf + 50.0 * score_cb DESC, feature LIMIT {n}")


@query("weighted_voting", _voting_sql(12, 15))
def _voting(spark, sf):
    v = S.weighted_voting(_rankings(spark, sf), _W, top_k=12, final_top_n=15)
    return v.select("feature", "votes", F.round("final_score", 9).alias("final_score"), "selected")


def _rank_conflict_sql(k=12, n=15, fill=("cb", "lr", "rf")):
    order = ["lr", "rf", "cb"]
    lists = " UNION ALL ".join(
        f"SELECT '{nm}' AS src, {_W[nm]} AS w, {order.index(nm)} AS lo, {fill.index(nm)} AS fo, feature, rk FROM "
        f"(SELECT feature, row_number() OVER (ORDER BY s DESC, feature) AS rk FROM ({_RANK[nm]})) WHERE rk <= {k}"
        for nm in order)
    return f"""
    WITH RECURSIVE l AS ({lists}),
    steps(pos, seen, chosen) AS (
      SELECT 0, []::VARCHAR[], []::STRUCT(feature VARCHAR, src VARCHAR, w DOUBLE, rk BIGINT)[]
      UNION ALL
      SELECT s.pos + 1,
             CASE WHEN p.feature IS NULL THEN s.seen ELSE list_append(s.seen, p.feature) END,
             CASE WHEN p.feature IS NULL THEN s.chosen
                  ELSE list_append(s.chosen, {{'feature': p.feature, 'src': p.src, 'w': p.w, 'rk': p.rk}}) END
      FROM steps s LEFT JOIN LATERAL (
          SELECT feature, src, w, rk FROM l WHERE l.rk = s.pos + 1 AND NOT list_contains(s.seen, l.feature)
          ORDER BY w DESC, lo LIMIT 1) p ON true
      WHERE s.pos < (SELECT max(rk) FROM l) AND len(s.chosen) < {n}),
    greedy AS (SELECT chosen FROM steps ORDER BY pos DESC LIMIT 1),
    g AS (SELECT CAST(i AS BIGINT) AS position, chosen[i].feature AS feature, chosen[i].src AS source,
                 chosen[i].w AS source_weight, chosen[i].rk AS rank_position
          FROM greedy, range(1, len(chosen) + 1) t(i)),
    rest AS (SELECT feature, src AS source, w AS source_weight, rk AS rank_position, fo FROM (
               SELECT *, row_number() OVER (PARTITION BY feature ORDER BY fo, rk) AS first_seen FROM l
               WHERE feature NOT IN (SELECT feature FROM g)) WHERE first_seen = 1),
    r AS (SELECT (SELECT count(*) FROM g) + row_number() OVER (ORDER BY fo, rank_position) AS position,
                 feature, source, source_weight, rank_position FROM rest)
    SELECT CAST(position AS INT) AS position, feature, source, source_weight, CAST(rank_position AS INT) AS rank_position
    FROM (SELECT * FROM g UNION ALL SELECT * FROM r) WHERE position <= {n}"""


@query("weighted_rank_conflict", _rank_conflict_sql())
def _rank_conflict(spark, sf):
    r = {k: O.rank_scores(df, f, s, 12, k).select("feature", F.col(f"rank_{k}").alias("rank"))
         for k, (df, f, s) in _rankings(spark, sf).items()}
    # rank order (no seeded shuffle) so that the greedy pass can be replayed in SQL
    return S.weighted_rank_conflict(r, _W, 15, shuffle=False)


@query("reduce_dataset", with_cte(
    "SELECT segment, nation, amount, buyout_flag FROM l WHERE sale_dt >= TIMESTAMP '1996-01-01' "
    "AND sale_dt <= TIMESTAMP '1999-12-31'", l=L))
def _reduce(spark, sf):
    return S.reduce_dataset(leads(spark, sf), ["segment", "nation", "status", "amount"], keep=["buyout_flag"],
                            blacklist=["status"], date_col="sale_dt", start="1996-01-01", end="1999-12-31")


# ---------------------------------------------------------------- pipelines
# The source's column names (the expressions beside them stand in for its data).
RAW_LEAD_COLUMNS = [
    ("lead_id", "o_orderkey"),
    ("buyout_flag", "CAST(o_orderstatus = 'F' AS INT)"),
    ("sale_ts", "CAST(unix_timestamp(o_orderdate) AS BIGINT)"),
    ("lead_created_at", "CAST(unix_timestamp(o_orderdate) AS BIGINT) - (o_orderkey % 5) * 86400"),
    ("lead_utm_campaign", "CASE WHEN o_orderkey % 9 = 0 THEN '{campaing_id}' WHEN o_orderkey % 9 = 1 THEN NULL "
                          "ELSE 'camp_' || CAST(o_orderkey % 13 AS STRING) END"),
    ("`lead_Высота`", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE c_acctbal / 400.0 END"),
    ("`lead_Вес (грамм)*`", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice / 100.0 END"),
    ("`lead_Вид оплаты`", "CASE WHEN o_orderkey % 3 = 0 THEN 'Наложенный платеж' WHEN o_orderkey % 3 = 1 THEN 'Карта' END"),
    ("`lead_Служба доставки`", "CASE o_orderkey % 6 WHEN 0 THEN 'СДЭК до ПВЗ' WHEN 1 THEN 'СДЭК до Двери' "
                               "WHEN 2 THEN 'Почта' WHEN 3 THEN 'Самовывоз' WHEN 4 THEN 'Курьер ЕМС' END"),
    ("lead_group", "CASE o_orderkey % 4 WHEN 0 THEN 'yur' WHEN 1 THEN 'but' WHEN 2 THEN 'misc' END"),
    # "X,YY" written with integer arithmetic (identical text in every engine; no half-way rounding)
    ("`lead_Стоимость доставки`", "CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE "
                                  "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',' || "
                                  "lpad(CAST(CAST(floor(o_totalprice / 10) AS BIGINT) % 100 AS STRING), 2, '0') END"),
    ("lead_utm_group", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) || '_' || "
                       "CAST(o_orderkey % 3 AS STRING) END"),
    ("lead_utm_referrer", "CASE o_orderkey % 5 WHEN 0 THEN 'https://artraid.example/' || lower(n_name) || '/varikoz-1' "
                          "WHEN 1 THEN 'https://npotpz.example/sleep' WHEN 2 THEN 'noslash' WHEN 3 THEN NULL "
                          "ELSE 'https://x.example/a/davlenie' END"),
    ("lead_tags", "CASE o_orderkey % 4 WHEN 0 THEN 'tilda, form' WHEN 1 THEN 'ВХОДЯЩИЙ звонок' WHEN 2 THEN 'misc' END"),
    ("lead_utm_content", "concat_ws('_', CAST(o_orderkey AS STRING), 'a', CAST(o_custkey AS STRING), 'b', "
                         "CASE WHEN o_orderkey % 3 = 0 THEN 'mobile' ELSE 'undefined' END, 'c', 'd', 'e', 'f', 'g')"),
    ("`lead_Длина`", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE c_nationkey * 2 END"),
]


def raw_leads(spark, sf):
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows
    return j.selectExpr(*[f"{e} AS {a}" for a, e in RAW_LEAD_COLUMNS])


@query("transform_chain", None)
def _chain(spark, sf):
    out = PL.transform_chain(raw_leads(spark, sf), PL.lead_feature_steps())
    # trigonometric output rounded so that engines with different libm agree in the check
    return out.withColumn("lead_creation_date_sin", F.round("lead_creation_date_sin", 9))


def _raw_leads_sql():
    cols = []
    for a, e in RAW_LEAD_COLUMNS:
        e = e.replace("CAST(unix_timestamp(o_orderdate) AS BIGINT)", "CAST(epoch(o_orderdate) AS BIGINT)")
        cols.append(f"{e} AS {a.replace('`', chr(34))}")
    return ("SELECT " + ", ".join(cols) + " FROM orders JOIN customer ON o_custkey = c_custkey "
            "JOIN nation ON c_nationkey = n_nationkey")


def _chain_columns():
    from tabsieve.functions import rules as R
    h = '"lead_Высота"'
    g0 = "regexp_extract(coalesce(lead_utm_group, ''), '^[A-Za-zА-Яа-яЁё]+', 0)"
    grp = f"CASE WHEN {g0} = '' THEN 'unknown' ELSE {g0} END"
    ref_last = "regexp_extract(lead_utm_referrer, '[^/]*$', 0)"
    ref_cat = ("CASE WHEN lead_utm_referrer IS NULL OR lead_utm_referrer = '' OR " + ref_last + " = '' THEN 'unknown' "
               + " ".join(f"WHEN contains(lower({ref_last}), '{k}') THEN '{k}'" for k in R.REFERRER_CATEGORIES)
               + " ELSE 'other' END")
    site = ("CASE WHEN lead_utm_referrer IS NULL OR lead_utm_referrer = '' THEN 'unknown' "
            + " ".join(f"WHEN contains(lower(lead_utm_referrer), '{k}') THEN '{k}'" for k in R.REFERRER_SITES)
            + " ELSE 'other' END")
    tags = ("CASE WHEN lead_tags IS NULL OR lead_tags = '' THEN 'unknown' "
            + " ".join(f"WHEN contains(lower(lead_tags), lower('{k}')) THEN '{k}'" for k in R.TAG_CATEGORIES)
            + " ELSE 'unknown' END")
    parts = "string_split(coalesce(lead_utm_content, 'None'), '_')"

    def part(k):
        return f"CASE WHEN len({parts}) = 10 THEN {parts}[{k}] ELSE 'unknown' END"

    def pid(k):
        v = f"TRY_CAST({part(k)} AS DOUBLE)"
        return f"coalesce(CASE WHEN {v} = floor({v}) THEN CAST({v} AS BIGINT) END, -1)"
    dev = f"CASE WHEN {part(5)} IN ('undefined', '') THEN 'unknown' ELSE {part(5)} END"
    deliv = ('CASE WHEN "lead_Служба доставки" IS NULL THEN \'unknown\' '
             + " ".join("WHEN \"lead_Служба доставки\" IN (" + ", ".join(f"'{v}'" for v in vals) + f") THEN '{lab}'"
                        for vals, lab in R.DELIVERY_RULES) + " ELSE 'other' END")
    pay = ('CASE WHEN "lead_Вид оплаты" IS NULL THEN \'unknown\' WHEN "lead_Вид оплаты" = '
           f"'{R.PAYMENT_CASH_ON_DELIVERY}' THEN 'cash_on_delivery' ELSE 'online' END")
    cost = ('TRY_CAST(replace(CASE WHEN trim("lead_Стоимость доставки") IN (\'-\', \'\') THEN NULL '
            'ELSE trim("lead_Стоимость доставки") END, \',\', \'.\') AS DOUBLE)')
    hclip = f"CASE WHEN {h} IS NULL THEN NULL ELSE least({h}, (SELECT q3 + 2 * (q3 - q1) FROM hq)) END"
    hbin = (f"CASE WHEN {hclip} IS NULL THEN 'unknown' WHEN {hclip} <= 4 THEN 'small' WHEN {hclip} <= 12 "
            "THEN 'medium' ELSE 'large' END")
    campaign = ("CASE WHEN coalesce(lead_utm_campaign IN ('" + "', '".join(R.UTM_CAMPAIGN_PLACEHOLDERS)
                + "'), false) THEN NULL ELSE lead_utm_campaign END")
    created = "to_timestamp(lead_created_at)::TIMESTAMP"
    cols = {
        "lead_id": "lead_id", "buyout_flag": "buyout_flag", "sale_ts": "to_timestamp(sale_ts)::TIMESTAMP",
        "lead_created_at": "lead_created_at", "lead_utm_campaign": campaign,
        '"lead_Высота"': f"coalesce({h}, -1.0)",
        '"lead_Вес (грамм)*"': '"lead_Вес (грамм)*"', '"lead_Вид оплаты"': '"lead_Вид оплаты"',
        '"lead_Служба доставки"': '"lead_Служба доставки"', "lead_group": "lead_group",
        '"lead_Стоимость доставки"': f"coalesce({cost}, -1.0)",
        "lead_utm_group": "CASE WHEN grp IN (SELECT v FROM top5) OR grp = 'unknown' THEN grp ELSE 'rare_utm_group' END",
        "lead_utm_referrer": ref_cat, "lead_tags": tags, "lead_utm_content": "lead_utm_content",
        '"lead_Длина"': '"lead_Длина"', "lead_length": 'coalesce("lead_Длина", -1)',
        "lead_utm_campaign_missing": f"CAST(({campaign}) IS NULL AS INT)",
        "lead_height_known": f"CAST({h} IS NOT NULL AS INT)", "lead_height_bin": hbin,
        "has_weight": 'CAST("lead_Вес (грамм)*" IS NOT NULL AS INT)',
        "lead_payment_type": pay, "lead_delivery_type": deliv,
        "lead_group_missing": "CAST(lead_group IS NULL AS INT)",
        "lead_group_grouped": "CASE WHEN coalesce(lead_group IN ('" + "', '".join(R.LEAD_GROUP_MAIN)
                              + "'), false) THEN lead_group ELSE 'other' END",
        "delivery_cost_missing": f"CAST({cost} IS NULL AS INT)", "lead_shipping_cost": f"coalesce({cost}, -1.0)",
        "lead_utm_referrer_site": site, "lead_utm_device_type": dev, "lead_utm_id_1": pid(1), "lead_utm_id_3": pid(3),
        "lead_creation_date_month": f"CAST(coalesce(month({created}), -1) AS INT)",
        "lead_creation_date_quarter": f"CAST(coalesce(quarter({created}), -1) AS INT)",
        "lead_creation_date_sin": f"round(coalesce(sin(2 * pi() * day({created}) / 30.0), -1.0), 9)",
        "timedelta_between_sale_and_creation": "CAST(sale_ts - lead_created_at AS DOUBLE)",
        "lead_created_ts": created,
        "lead_created_dayofweek": f"CAST(coalesce(isodow({created}) - 1, -1) AS INT)",
    }
    return cols


def _chain_sql(names=None):
    cols = _chain_columns()
    keep = [k for k in cols if names is None or k.strip('"') in names]
    body = "SELECT " + ", ".join(f"{cols[k]} AS {k}" for k in keep) + " FROM g"
    h = '"lead_Высота"'
    g0 = "regexp_extract(coalesce(lead_utm_group, ''), '^[A-Za-zА-Яа-яЁё]+', 0)"
    grp = f"CASE WHEN {g0} = '' THEN 'unknown' ELSE {g0} END"
    return with_cte(
        body, r=_raw_leads_sql(),
        g=f"SELECT *, {grp} AS grp FROM r",
        top5="SELECT v FROM (SELECT grp AS v, count(*) AS n FROM g WHERE grp <> 'unknown' GROUP BY grp "
             "ORDER BY n DESC, v LIMIT 5)",
        hq=f"SELECT quantile_cont({h}, 0.25) AS q1, quantile_cont({h}, 0.75) AS q3 FROM r")


def _final_sql():
    return _chain_sql(S.FINAL_COLUMNS + ["sale_ts"])


@query("project_final", _final_sql())
def _project_final(spark, sf):
    return S.project_final(PL.transform_chain(raw_leads(spark, sf), PL.lead_feature_steps()), keep_time="sale_ts")


# Structured lead table: (name, Spark expression, DuckDB expression or None if equal)
STRUCTURED_COLUMNS = [
    ("lead_id", "o_orderkey", None),
    ("buyout_flag", "CAST(o_orderstatus = 'F' AS INT)", None),
    ("lead_Ширина", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_nationkey * 3 END", None),
    ("lead_Линейная высота (см)", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE c_nationkey END", None),
    ("lead_Вид оплаты", "CASE WHEN o_orderkey % 3 = 0 THEN 'Наложенный платеж' WHEN o_orderkey % 3 = 1 THEN 'Карта' END", None),
    ("lead_Служба доставки", "CASE o_orderkey % 6 WHEN 0 THEN 'СДЭК до ПВЗ' WHEN 1 THEN 'СДЭК до Двери' WHEN 2 THEN 'Почта' "
                             "WHEN 3 THEN 'Самовывоз' WHEN 4 THEN 'Курьер' END", None),
    ("lead_Компания Отправитель", "c_mktsegment", None),
    ("lead_group_id", "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 40 END", None),
    ("lead_Масса (гр)", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE c_acctbal END", None),
    ("contact_created_dt", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END", None),
    ("contact_updated_dt", "o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 9 AS INT) - 2)",
     "o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER) - 2)"),
    ("lead_utm_medium", "CASE o_orderkey % 4 WHEN 0 THEN 'CPC' WHEN 1 THEN 'yandex_cpm' WHEN 2 THEN 'email' END", None),
    ("lead_Категория и варианты выбора", "CASE WHEN o_orderkey % 5 = 0 THEN 'Нет категории' WHEN o_orderkey % 5 = 1 THEN NULL "
                                         "ELSE c_mktsegment END", None),
    ("lead_Модель телефона", "CASE o_orderkey % 3 WHEN 0 THEN 'Кнопочный' WHEN 1 THEN 'Смартфон' END", None),
    ("lead_created_dt", "o_orderdate", None),
    ("handed_to_delivery_dt", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + "
                              "make_interval(0, 0, 0, CAST(o_orderkey % 15 AS INT) - 3) END",
     "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 15 AS INTEGER) - 3) END"),
    ("sale_date_dt", "o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 5 AS INT))",
     "o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER))"),
    ("lead_utm_campaign", "CASE WHEN o_orderkey % 9 = 0 THEN '{campaing_id}' WHEN o_orderkey % 9 = 1 THEN 'Неизвестно' "
                          "WHEN o_orderkey % 9 = 2 THEN NULL ELSE 'camp_' || CAST(o_custkey % 60 AS STRING) END", None),
    ("contact_Источник трафика", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'src_' || CAST(o_custkey % 35 AS STRING) END", None),
    ("lead_Дата перехода в Сборку", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + "
                                    "make_interval(0, 0, 0, CAST(o_orderkey % 50 AS INT)) END",
     "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 50 AS INTEGER)) END"),
    ("lead_utm_term", "CASE WHEN o_orderkey % 7 = 0 THEN 'Неизвестно' WHEN o_orderkey % 7 = 1 THEN NULL "
                      "ELSE 'term_' || CAST(o_custkey % 90 AS STRING) END", None),
    ("lead_utm_sky", "CASE o_orderkey % 7 WHEN 0 THEN '{keyword}' WHEN 1 THEN '---autotargeting' WHEN 2 THEN 'Артрейд купить' "
                     "WHEN 3 THEN 'лечение ВАРИКОЗА вены' WHEN 4 THEN 'SLEEP mask' WHEN 5 THEN 'другое' END", None),
    ("lead_group", "CASE o_orderkey % 4 WHEN 0 THEN 'yur' WHEN 1 THEN 'but' WHEN 2 THEN 'misc' END", None),
    ("lead_Проблема", "CASE o_orderkey % 5 WHEN 0 THEN 'Варикоз' WHEN 1 THEN 'Давление' WHEN 2 THEN 'Иное' WHEN 3 THEN 'Отеки' END", None),
]


# dates that the structured transforms clip, by transform
CLIPPED_DATES = {
    "contact_update_delay": ["contact_created_dt", "contact_updated_dt"],
    "delivery_delays": ["lead_created_dt", "handed_to_delivery_dt", "sale_date_dt"],
    "assembly_delay": ["lead_created_dt", "lead_Дата перехода в Сборку"],
}


def structured_leads(spark, sf):
    j = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.selectExpr(*[f"{e} AS `{a}`" for a, e, _ in STRUCTURED_COLUMNS])


def _lead_set_sql(clip=None):
    """SQL of the features; ``clip`` (start, end) sets the clipped date columns outside it to NULL first."""
    from tabsieve.plans import structured as SX
    raw = ("SELECT " + ", ".join(f'{d or e} AS "{a}"' for a, e, d in STRUCTURED_COLUMNS)
           + " FROM orders JOIN customer ON o_custkey = c_custkey")
    flag = lambda cond: f"CAST(coalesce({cond}, false) AS INT)"
    days = lambda a, b: f"CASE WHEN {b} >= {a} THEN (epoch({b}) - epoch({a})) / 86400.0 END"
    clean = lambda col, marks: f"CASE WHEN {col} IN ({', '.join(repr(m) for m in marks)}) THEN NULL ELSE {col} END"
    top = lambda v, k, other: (
        f"CASE WHEN {v} IN (SELECT v FROM (SELECT {v} AS v, count(*) AS n FROM t WHERE {v} IS NOT NULL GROUP BY 1 "
        f"ORDER BY n DESC, v LIMIT {k})) THEN {v} ELSE '{other}' END")
    contact, l2d = days("contact_created_dt", "contact_updated_dt"), days("lead_created_dt", "handed_to_delivery_dt")
    s2d, asm = days("sale_date_dt", "handed_to_delivery_dt"), '"lead_Дата перехода в Сборку"'
    wait = f"(epoch({asm}) - epoch(lead_created_dt)) / 86400.0 + 1"
    main = ", ".join(f"'{p}'" for p in SX.PROBLEM_MAIN)
    cols = {
        "lead_id": "lead_id", "buyout_flag": "buyout_flag", "lead_created_dt": "lead_created_dt", "sale_date_dt": "sale_date_dt",
        "width_cat": 'CASE WHEN "lead_Ширина" IS NULL THEN \'unknown\' WHEN "lead_Ширина" < 10 OR "lead_Ширина" > 50 THEN '
                     '\'anomaly\' WHEN "lead_Ширина" < 25 THEN \'small\' WHEN "lead_Ширина" <= 35 THEN \'normal\' ELSE \'large\' END',
        "lead_height_known": 'CAST("lead_Линейная высота (см)" IS NOT NULL AS INT)',
        "lead_payment_type": 'CASE WHEN "lead_Вид оплаты" IS NULL THEN \'unknown\' WHEN "lead_Вид оплаты" = '
                             '\'Наложенный платеж\' THEN \'cash_on_delivery\' ELSE \'online\' END',
        "lead_delivery_type": 'CASE WHEN "lead_Служба доставки" IN (\'СДЭК до ПВЗ\', \'Самовывоз\') THEN \'pickup_point\' WHEN '
                              '"lead_Служба доставки" IN (\'СДЭК до Двери\', \'Курьер ЕМС\') THEN \'door_delivery\' WHEN '
                              '"lead_Служба доставки" = \'Почта\' THEN \'post\' ELSE \'unknown\' END',
        "lead_group_quality": "round(avg(buyout_flag) OVER (PARTITION BY lead_group_id), 9)",
        "lead_mass_known": 'CAST("lead_Масса (гр)" IS NOT NULL AS INT)',
        "lead_mass_log": 'round(CASE WHEN "lead_Масса (гр)" >= 0 THEN ln(1 + "lead_Масса (гр)") ELSE 0 END, 9)',
        "contact_update_delay_log": f"round(ln(1 + coalesce({contact}, (SELECT median({contact}) FROM t))), 9)",
        "is_paid_traffic": flag("regexp_matches(lower(lead_utm_medium), 'cpc|cpm')"),
        "lead_category_freq": "round(count(*) OVER (PARTITION BY cat) / (SELECT CAST(count(*) AS DOUBLE) FROM t), 9)",
        "is_feature_phone": flag('"lead_Модель телефона" = \'Кнопочный\''),
        "lead_to_delivery_days_log": f"round(coalesce(ln(1 + {l2d}), -1), 9)", "lead_to_delivery_days_missing": f"CAST(({l2d}) IS NULL AS INT)",
        "sale_to_delivery_log": f"round(coalesce(ln(1 + {s2d}), -1), 9)", "sale_to_delivery_missing": f"CAST(({s2d}) IS NULL AS INT)",
        "lead_utm_campaign_missing": "CAST(camp IS NULL AS INT)", "lead_utm_campaign_grouped": top("camp", 20, "unknown"),
        "traffic_source_missing": "CAST(src IS NULL AS INT)", "traffic_source_grouped": top("src", 20, "other"),
        "assembly_flag": f"CAST({asm} IS NOT NULL AS INT)", "lead_to_assembly_long": flag(f"{wait} > 30"),
        "lead_to_assembly_days": f"CASE WHEN {asm} IS NULL THEN -1.0 ELSE round(least({wait}, 30.0), 9) END",
        "utm_term_missing": "CAST(term IS NULL AS INT)", "utm_term_grouped": top("term", 40, "other"),
        "utm_sky_missing": "CAST(sky IS NULL AS INT)", "utm_sky_autotarget": flag("sky = '---autotargeting'"),
        "utm_sky_brand": flag("regexp_matches(lower(sky), 'artraid|артрейд')"),
        "utm_sky_varicose": flag("regexp_matches(lower(sky), 'варикоз|вены|флеболог')"),
        "utm_sky_sleep": flag("regexp_matches(lower(sky), 'сон|sleep')"),
        "lead_group_missing": "CAST(lead_group IS NULL AS INT)",
        "lead_group_grouped": "CASE WHEN lead_group IN ('yur', 'but') THEN lead_group ELSE 'other' END",
        "problem_missing": 'CAST("lead_Проблема" IS NULL AS INT)',
        "problem_grouped": f'CASE WHEN "lead_Проблема" IN ({main}) THEN "lead_Проблема" ELSE \'other\' END',
    }
    return with_cte(
        "SELECT " + ", ".join(f"{e} AS {a}" for a, e in cols.items()) + " FROM t", r=raw if not clip else "SELECT * REPLACE (" + ", ".join(
            f'CASE WHEN "{c}" BETWEEN TIMESTAMP \'{clip[0]}\' AND TIMESTAMP \'{clip[1]}\' THEN "{c}" END AS "{c}"'
            for c in sorted({c for own in CLIPPED_DATES.values() for c in own})) + f") FROM ({raw})",
        t="SELECT *, " + clean("lead_utm_campaign", ["{campaing_id}", "Неизвестно"]) + ' AS camp, "contact_Источник трафика" AS src, '
          + clean("lead_utm_term", ["Неизвестно"]) + " AS term, " + clean("lead_utm_sky", ["{keyword}"]) + " AS sky, "
          'CASE WHEN "lead_Категория и варианты выбора" = \'Нет категории\' THEN \'unknown\' ELSE '
          'coalesce("lead_Категория и варианты выбора", \'unknown\') END AS cat FROM r')


@query("lead_feature_set", _lead_set_sql())
def _lead_set(spark, sf):
    from tabsieve.plans import structured as SX
    out, _ = SX.apply(structured_leads(spark, sf), SX.transforms())
    rounded = ["lead_group_quality", "lead_mass_log", "contact_update_delay_log", "lead_category_freq",
               "lead_to_delivery_days_log", "sale_to_delivery_log", "lead_to_assembly_days"]
    return out.withColumns({c: F.round(c, 9) for c in rounded})


CLIP = ("1993-01-01", "1998-01-01")


def _observed_plan_sql():
    from tabsieve.plans import structured as SX
    raw = ("SELECT " + ", ".join(f'{d or e} AS "{a}"' for a, e, d in STRUCTURED_COLUMNS)
           + " FROM orders JOIN customer ON o_custkey = c_custkey")
    have = [a for a, _, _ in STRUCTURED_COLUMNS]
    rows, done = [], set()
    for t in SX.transforms():
        new = [c for c in CLIPPED_DATES.get(t.name, []) if c not in done]  # a date that is NULL already is not clipped again
        done |= set(new)
        clipped = " + ".join(f"count(*) FILTER (\"{c}\" NOT BETWEEN TIMESTAMP '{CLIP[0]}' AND TIMESTAMP '{CLIP[1]}')" for c in new)
        rows.append(f"SELECT '{t.name}' AS transform, '{','.join(t.needs)}' AS required, '' AS missing, true AS runnable, "
                    f"'{','.join(t.makes)}' AS new_columns, '{','.join(c for c in t.drops if c in have)}' AS dropped, "
                    f"'{','.join(c for c in t.drops if c not in have)}' AS skipped_drops, (SELECT count(*) FROM f) AS rows, "
                    f"(SELECT {' + '.join(f'count({c})' for c in t.makes)} FROM f) AS filled, "
                    f"(SELECT {clipped or '0'}::BIGINT FROM x{'' if clipped else ' LIMIT 1'}) AS clipped")
    return with_cte(" UNION ALL ".join(rows), f=_lead_set_sql(CLIP), x=raw)


def _observed_stats_sql():
    from tabsieve.plans import structured as SX
    text = {"width_cat", "lead_payment_type", "lead_delivery_type"}
    rows = [f"SELECT '{t.name}' AS transform, '{c}' AS feature, count({c}) AS filled, "
            + (f"CAST(NULL AS DOUBLE) AS mean, count(DISTINCT {c}) AS levels" if c in text or c.endswith("_grouped") else
               f"round(avg({c}), 6) AS mean, CAST(NULL AS BIGINT) AS levels") + " FROM f"
            for t in SX.transforms() for c in t.makes]
    return with_cte(" UNION ALL ".join(rows), f=_lead_set_sql(CLIP))


def _observed(spark, sf):
    from tabsieve.plans import structured as SX
    path = f"{checkpoint_dir(spark)}/lead-features-{uuid.uuid4().hex}"
    return SX.write_observed(structured_leads(spark, sf), SX.transforms(start=CLIP[0], end=CLIP[1]), path)


@query("lead_feature_plan", _observed_plan_sql())
def _lead_plan(spark, sf):
    """All transforms with what they did to the whole table, seen by the write itself."""
    return _observed(spark, sf)[0]


@query("lead_feature_statistics", _observed_stats_sql())
def _lead_statistics(spark, sf):
    return _observed(spark, sf)[1].withColumn("mean", F.round("mean", 6))


def _cleaning_sql(cols=None, steps=("empty", "dominant", "duplicate", "manual"), step_type="INT",
                  count_type="INT"):
    from tabsieve.plans.catalog_profile import ALL
    ALL = list(cols or ALL)  # noqa: N806
    from tabsieve.plans.registry import d_empty, d_level_stats, d_norm
    empties = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({d_empty(c)} AS DOUBLE)) AS share FROM l" for c in ALL)
    pairs = []
    for i, a in enumerate(ALL):
        for b in ALL[i + 1:]:
            pairs.append(f"SELECT '{a}' AS lf, '{b}' AS rt, sum(CAST({d_norm(a)} <> {d_norm(b)} AS INT)) AS mm FROM l")
    gone = lambda *ds: " UNION ALL ".join(f"SELECT feature FROM {d}" for d in ds)

    def step(i, name, d, prior):
        before = f"{len(ALL)} - (SELECT count(*) FROM ({gone(*prior)}))" if prior else str(len(ALL))
        after = f"{len(ALL)} - (SELECT count(*) FROM ({gone(*(prior + [d]))}))"
        return (f"SELECT CAST({i} AS {step_type}) AS step, '{name}' AS analyzer, feature, "
                f"CAST({before} AS {count_type}) AS cols_before, CAST({after} AS {count_type}) AS cols_after "
                f"FROM (SELECT feature FROM {d} UNION ALL SELECT NULL WHERE NOT EXISTS (SELECT 1 FROM {d}))")
    names = {"empty": ("empty_features", "d0"), "dominant": ("dominant_value", "d1"),
             "duplicate": ("duplicate_features", "d2"), "manual": ("manual_drop", "d3")}
    parts, prior = [], []
    for i, k in enumerate(steps):
        name, d = names[k]
        parts.append(step(i, name, d, list(prior)))
        prior.append(d)
    body = ("SELECT step, analyzer, feature, (SELECT count(*) FROM l) AS rows_before, cols_before, cols_after FROM ("
            + " UNION ALL ".join(parts) + ")")
    return with_cte(
        body, l=L if cols is None else f"SELECT {', '.join(ALL)} FROM ({L})", e=empties,
        d0="SELECT feature FROM e WHERE share >= 0.95 AND feature <> 'buyout_flag'",
        ls=d_level_stats("l", ALL),
        d1="SELECT feature FROM ls WHERE non_empty_count >= 3 AND top_count / non_empty_count >= 1.0 "
           "AND feature NOT IN (SELECT feature FROM d0) AND feature <> 'buyout_flag'",
        ps=" UNION ALL ".join(pairs),
        d2="SELECT DISTINCT rt AS feature FROM ps WHERE mm = 0 AND lf NOT IN (SELECT feature FROM d0 UNION ALL "
           "SELECT feature FROM d1) AND rt NOT IN (SELECT feature FROM d0 UNION ALL SELECT feature FROM d1) "
           "AND rt <> 'buyout_flag'",
        d3="SELECT 'status' AS feature WHERE 'status' NOT IN (SELECT feature FROM d0 UNION ALL SELECT feature FROM d1 "
           "UNION ALL SELECT feature FROM d2)")


from tabsieve.plans.registry import ORACLES  # noqa: E402
from tabsieve.plans.catalog_profile import _report_oracle  # noqa: E402

ORACLES["write_audit_report"] = _report_oracle()
ORACLES["transform_chain"] = _chain_sql()


@query("cleaning_pipeline", _cleaning_sql())
def _cleaning(spark, sf):
    d = leads(spark, sf)
    _, rep = PL.cleaning_pipeline(d, "buyout_flag", manual={"status": "post-event status"}, order_cols=["lead_id"])
    return rep.steps_table(spark)


@query("cleaned_table", with_cte(
    "SELECT * EXCLUDE (mostly_empty, const_col, segment_copy, status), row_number() OVER (ORDER BY lead_id) - 1 AS row_id FROM l",
    l=L))
def _cleaned(spark, sf):
    out, _ = PL.cleaning_pipeline(leads(spark, sf), "buyout_flag", manual={"status": "post-event status"},
                                  order_cols=["lead_id"])
    return out


# ---------------------------------------------------------------- §2.12
_SC = ("SELECT lead_id, segment, nation, priority, amount, acctbal, price, CASE WHEN lead_id % 17 = 0 THEN NULL ELSE "
       "buyout_flag END AS y, CASE WHEN lead_id % 13 = 0 THEN NULL ELSE score END AS p0 FROM l")
_ET = ("CASE WHEN p0 >= 0.15 AND y = 0 THEN 'tp_0' WHEN p0 < 0.15 AND y = 0 THEN 'fn_0' "
       "WHEN p0 >= 0.15 AND y = 1 THEN 'fp_0' WHEN p0 < 0.15 AND y = 1 THEN 'tn_0' ELSE 'unknown' END")


def _labelled(spark, sf):
    d = leads(spark, sf).select("lead_id", "segment", "nation", "priority", "amount", "acctbal", "price",
                                F.when(F.col("lead_id") % 17 != 0, F.col("buyout_flag")).alias("y"),
                                F.when(F.col("lead_id") % 13 != 0, F.col("score")).alias("p0"))
    return V.confusion_labels(d, "y", "p0", 0.15)


@query("error_partitions", with_cte(f"SELECT {_ET} AS error_type, count(*) AS n FROM s GROUP BY 1", l=L, s=_SC))
def _err_parts(spark, sf):
    path = f"{checkpoint_dir(spark)}/errors-{uuid.uuid4().hex}"
    ER.error_partitions(_labelled(spark, sf), path)
    return spark.read.parquet(path).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("numeric_mean_diff", with_cte(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE et = 'fp_0'), 6) AS fp_0_mean, "
    f"round(avg({c}) FILTER (WHERE et = 'tn_0'), 6) AS tn_0_mean, round(avg({c}) FILTER (WHERE et = 'fp_0') - "
    f"avg({c}) FILTER (WHERE et = 'tn_0'), 6) AS signed_diff, round(abs(avg({c}) FILTER (WHERE et = 'fp_0') - "
    f"avg({c}) FILTER (WHERE et = 'tn_0')), 6) AS abs_diff FROM e" for c in ("amount", "acctbal", "price")),
    l=L, s=_SC, e=f"SELECT *, {_ET} AS et FROM s"))
def _num_diff(spark, sf):
    t = ER.numeric_mean_diff(_labelled(spark, sf), ["amount", "acctbal", "price"], "error_type", "fp_0", "tn_0")
    return t.select("feature", *[F.round(c, 6).alias(c) for c in ("fp_0_mean", "tn_0_mean", "signed_diff", "abs_diff")])


@query("categorical_share_diff", with_cte(
    "SELECT feature, value, round(na / (SELECT count(*) FROM e WHERE et = 'fp_0'), 9) AS fp_0_share, "
    "round(nb / (SELECT count(*) FROM e WHERE et = 'tn_0'), 9) AS tn_0_share, "
    "round(abs(na / (SELECT count(*) FROM e WHERE et = 'fp_0') - nb / (SELECT count(*) FROM e WHERE et = 'tn_0')), 9) AS abs_diff, "
    "round(na / (SELECT count(*) FROM e WHERE et = 'fp_0') - nb / (SELECT count(*) FROM e WHERE et = 'tn_0'), 9) AS signed_diff "
    "FROM (SELECT feature, value, count(*) FILTER (WHERE et = 'fp_0') AS na, count(*) FILTER (WHERE et = 'tn_0') AS nb FROM (" +
    " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'missing') AS value, et FROM e "
                       f"WHERE et IN ('fp_0', 'tn_0')" for c in ("segment", "priority")) + ") GROUP BY feature, value)",
    l=L, s=_SC, e=f"SELECT *, {_ET} AS et FROM s"))
def _cat_diff(spark, sf):
    t = ER.categorical_share_diff(_labelled(spark, sf), ["segment", "priority"], "error_type", "fp_0", "tn_0")
    return t.select("feature", "value", *[F.round(c, 9).alias(c) for c in ("fp_0_share", "tn_0_share", "abs_diff", "signed_diff")])


@query("value_set_union", with_cte(
    "SELECT DISTINCT coalesce(segment, 'missing') AS value FROM e WHERE et IN ('fp_0', 'tn_0')",
    l=L, s=_SC, e=f"SELECT *, {_ET} AS et FROM s"))
def _value_set_union(spark, sf):
    lab = _labelled(spark, sf)
    a = lab.where("error_type = 'fp_0'").select(F.coalesce("segment", F.lit("missing")).alias("value"))
    b = lab.where("error_type = 'tn_0'").select(F.coalesce("segment", F.lit("missing")).alias("value"))
    return a.union(b).distinct()


@query("cluster_errors", None)
def _clusters(spark, sf):
    fp = _labelled(spark, sf).where("error_type = 'fp_0'")
    out = M.cluster_errors(fp, ["amount", "acctbal", "price"], ["segment", "priority"], k=4)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query("cluster_profile", with_cte(
    "SELECT cluster, size, round(size / (SELECT count(*) FROM c), 9) AS share, round(mean_p0, 9) AS mean_p0, "
    "segment_top, round(segment_top_share, 9) AS segment_top_share FROM (SELECT cluster, count(*) AS size, "
    "avg(p0) AS mean_p0 FROM c GROUP BY cluster) b JOIN (SELECT cluster, value AS segment_top, n / sz AS segment_top_share "
    "FROM (SELECT cluster, value, n, sum(n) OVER (PARTITION BY cluster) AS sz, row_number() OVER (PARTITION BY cluster "
    "ORDER BY n DESC, value) AS rn FROM (SELECT cluster, coalesce(segment, 'missing') AS value, count(*) AS n FROM c "
    "GROUP BY ALL)) WHERE rn = 1) t USING (cluster)",
    l=L, s=_SC, c=f"SELECT *, 1 - p0 AS p1, lead_id % 4 AS cluster FROM s WHERE {_ET} = 'fp_0'"))
def _cluster_profile(spark, sf):
    fp = _labelled(spark, sf).where("error_type = 'fp_0'").withColumn("p1", 1 - F.col("p0")).withColumn(
        "cluster", F.col("lead_id") % 4)
    t = ER.cluster_profile(fp, "cluster", ["segment"])
    return t.select("cluster", "size", F.round("share", 9).alias("share"), F.round("mean_p0", 9).alias("mean_p0"),
                    "segment_top", F.round("segment_top_share", 9).alias("segment_top_share"))


@query("compare_datasets", with_cte(
    "SELECT 'segment' AS feature, 'compared' AS status, count(*) FILTER (WHERE a.segment IS NOT NULL AND "
    "b.segment IS NOT NULL AND a.segment <> b.segment) AS n_diff FROM a FULL JOIN b USING (lead_id) UNION ALL "
    "SELECT 'amount', 'compared', count(*) FILTER (WHERE a.amount IS NOT NULL AND b.amount IS NOT NULL AND "
    "a.amount <> b.amount) FROM a FULL JOIN b USING (lead_id) UNION ALL SELECT 'nation', 'missing_right', NULL "
    "UNION ALL SELECT 'priority', 'missing_left', NULL",
    l=L, a="SELECT lead_id, segment, amount, nation FROM l",
    b="SELECT lead_id, segment_near AS segment, CASE WHEN lead_id % 11 = 0 THEN amount + 1 ELSE amount END AS amount, "
      "priority FROM (SELECT * REPLACE (CASE WHEN lead_id % 7 = 0 THEN -lead_id ELSE lead_id END AS lead_id) FROM l)"))
def _compare(spark, sf):
    d = leads(spark, sf)
    a = d.select("lead_id", "segment", "amount", "nation")
    # every seventh key differs between the sides, so the full join sees one-sided keys
    b = d.withColumn("lead_id", F.when(F.col("lead_id") % 7 == 0, -F.col("lead_id")).otherwise(F.col("lead_id"))).select(
        "lead_id", F.col("segment_near").alias("segment"),
        F.when(F.col("lead_id") % 11 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"), "priority")
    return ER.compare_datasets(a, b, "lead_id")


_PAIR = ("SELECT CAST(lead_id AS BIGINT) AS lead_id, a.segment AS ls, b.segment AS rs, a.amount AS la, b.amount AS ra FROM a JOIN b USING (lead_id)")


@query("dataset_differences", with_cte(
    "SELECT * FROM (SELECT lead_id, 'amount' AS feature, CAST(la AS VARCHAR) AS left_value, CAST(ra AS VARCHAR) AS right_value FROM j "
    "WHERE la <> ra UNION ALL SELECT lead_id, 'segment', ls, rs FROM j WHERE ls <> rs) ORDER BY lead_id, feature LIMIT 200",
    l=L, a="SELECT lead_id, segment, CAST(floor(amount) AS BIGINT) AS amount FROM l",
    b="SELECT lead_id, CASE WHEN lead_id % 29 = 0 THEN 'other' ELSE segment END AS segment, "
      "CAST(floor(amount) AS BIGINT) + CASE WHEN lead_id % 37 = 0 THEN 1 ELSE 0 END AS amount FROM l", j=_PAIR))
def _differences(spark, sf):
    d = leads(spark, sf)
    a = d.select(F.col("lead_id").cast("long").alias("lead_id"), "segment", F.floor("amount").alias("amount"))
    b = a.select("lead_id", F.when(F.col("lead_id") % 29 == 0, "other").otherwise(F.col("segment")).alias("segment"),
                 (F.col("amount") + F.when(F.col("lead_id") % 37 == 0, 1).otherwise(0)).alias("amount"))
    return ER.difference_sample(a, b, "lead_id", rows=200)


@query("sanity_assert", with_cte(
    "SELECT 'spend_before' AS feature, CAST(min(s) AS DOUBLE) AS min_value, coalesce(min(s) >= 0, true) AS ok FROM "
    "(SELECT sum(greatest(coalesce(amount, 0), 0)) OVER (PARTITION BY contact_id ORDER BY sale_dt, lead_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM l)", l=L))
def _sanity(spark, sf):
    d = leads(spark, sf).select("lead_id", "contact_id", "sale_dt", "amount")
    h = O.customer_history(d, "contact_id", "sale_dt", "lead_id", "amount", block_rows=512)
    h = h.withColumn("spend_before", F.when(F.col("past_orders") > 0, F.col("spend_before")))
    return ER.sanity_assert_nonnegative(h, ["spend_before"])


# ---------------------------------------------------------------- §2.13
@query("streaming_transform",
       "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority IN (SELECT v FROM (SELECT o_orderpriority AS v, "
       "count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) "
       "THEN o_orderpriority ELSE 'other' END AS priority_top, CAST(o_totalprice > (SELECT median(o_totalprice) "
       "FROM orders) AS INT) AS price_high, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders")
def _stream(spark, sf):
    from tabsieve.streaming.stream import fitted_transform_stream
    return fitted_transform_stream(spark, sf)
