"""Feature selection strategies and dataset reduction.

Rankings are small tables (one row per feature); voting is a full outer
join of the ranked lists plus one ordered ``limit``. The reducer is a
``where`` + ``select`` that Catalyst pushes into the scan.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.ordered import rank_scores

# Default voting parameters.
VOTING_DEFAULTS = dict(top_k=60, final_top_n=40, min_votes=2, weights={"lr": 40.0, "rf": 10.0, "cb": 50.0})


def weighted_voting(rankings: dict[str, tuple[DataFrame, str, str]], weights: dict[str, float],
                    top_k: int | dict = 60, final_top_n: int = 40, min_votes: int = 2) -> DataFrame:
    """Combine ranked lists: per list rank / score (k - rank + 1) / k / vote; full outer join;
    votes = sum of votes, final_score = weighted sum; rows with votes >= min_votes first, backfilled
    to ``final_top_n`` by (votes, final_score); feature name breaks ties.

    ``rankings`` maps a list name to (frame, feature column, score column).
    """
    ranked = []
    for name, (df, fcol, scol) in rankings.items():
        k = top_k[name] if isinstance(top_k, dict) else top_k
        src = df.where(F.col(fcol).isNotNull()).select(F.col(fcol).cast("string").alias("feature"),
                                                       F.col(scol).alias("_s"))
        ranked.append(rank_scores(src, "feature", "_s", k, name))
    joined = functools.reduce(lambda a, b: a.join(b, "feature", "full"), ranked)
    names = list(rankings)
    filled = joined.fillna(0, subset=[f"{p}_{n}" for n in names for p in ("rank", "score", "vote")])
    votes = sum(F.col(f"vote_{n}") for n in names)
    score = sum(F.lit(float(weights[n])) * F.col(f"score_{n}") for n in names)
    out = filled.withColumn("votes", votes.cast("bigint")).withColumn("final_score", score)
    # selected (votes >= min) come first by construction of the order; extras fill up to N
    return (out.withColumn("selected", (F.col("votes") >= min_votes).cast("int"))
            .orderBy(F.desc("votes"), F.desc("final_score"), F.asc("feature")).limit(final_top_n))


MAX_LIST = 100_000  # names per ranked list; the greedy pass runs on the driver


def weighted_rank_conflict(rankings: dict[str, DataFrame], weights: dict[str, float], n_final: int,
                           fill_order=("cb", "lr", "rf"), seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Rank-position conflict resolution between ranked lists.

    Each list (feature, rank) is optionally reordered by a seeded hash of the
    feature name (the reference shuffles its lists with a seeded generator).
    Then, position by position, the candidates of all lists are deduplicated
    keeping the heaviest list, and the heaviest candidate not yet chosen is
    taken (equal weights keep the lists' given order). Leftovers are appended
    list by list in ``fill_order``. The lists are top-k tables (k names each),
    so the greedy pass runs on the driver over the collected names.
    Output: (position, feature, source, source_weight, rank_position).
    """
    lists = {}
    for n, df in rankings.items():
        order = [F.xxhash64(F.lit(seed), F.col("feature")), F.col("feature")] if shuffle else ["rank", "feature"]
        names_n = [r["feature"] for r in df.orderBy(*order).limit(MAX_LIST + 1).collect()]
        if len(names_n) > MAX_LIST:
            raise ValueError(f"list {n} has more than {MAX_LIST} names: pass top-k lists")
        lists[n] = names_n
    names = list(lists)
    by_weight = sorted(names, key=lambda n: -weights.get(n, 0.0))  # stable: equal weights keep list order
    chosen: list[tuple[str, str, float, int]] = []
    seen = set()
    depth = max((len(v) for v in lists.values()), default=0)
    for pos in range(depth):
        if len(chosen) >= n_final:
            break
        for n in by_weight:
            if pos < len(lists[n]) and lists[n][pos] not in seen:
                seen.add(lists[n][pos])
                chosen.append((lists[n][pos], n, float(weights.get(n, 0.0)), pos + 1))
                break
    for n in fill_order:
        for pos, f in enumerate(lists.get(n, [])):
            if len(chosen) >= n_final:
                break
            if f not in seen:
                seen.add(f)
                chosen.append((f, n, float(weights.get(n, 0.0)), pos + 1))
    spark = next(iter(rankings.values())).sparkSession
    return spark.createDataFrame([(i + 1, f, n, w, p) for i, (f, n, w, p) in enumerate(chosen[:n_final])],
                                 "position int, feature string, source string, source_weight double, "
                                 "rank_position int")


def reduce_dataset(df: DataFrame, selected: list[str], keep: list[str] | None = None,
                   blacklist: list[str] | None = None, date_col: str | None = None,
                   start: str | None = None, end: str | None = None) -> DataFrame:
    """Date filter, then selected + always-keep columns in order (missing -> error), minus blacklist."""
    out = df
    if date_col and (start or end):
        if start:
            out = out.where(F.col(date_col) >= F.lit(start).cast("timestamp_ntz"))
        if end:
            out = out.where(F.col(date_col) <= F.lit(end).cast("timestamp_ntz"))
    cols = []
    for c in list(selected) + list(keep or []):
        if c not in cols:
            cols.append(c)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in the dataset: {missing}")
    cols = [c for c in cols if c not in set(blacklist or [])]
    return out.select(*cols)


# The 17-column final projection (plus the time column kept for splitting).
FINAL_COLUMNS = ["lead_utm_group", "lead_utm_referrer", "lead_tags", "has_weight", "lead_utm_referrer_site",
                 "lead_utm_id_1", "lead_utm_id_3", "lead_utm_device_type", "lead_creation_date_quarter",
                 "lead_length", "lead_payment_type", "lead_delivery_type", "lead_utm_campaign_missing",
                 "lead_group_missing", "lead_height_bin", "delivery_cost_missing", "buyout_flag"]


def project_final(df: DataFrame, columns: list[str] = FINAL_COLUMNS, keep_time: str | None = None) -> DataFrame:
    cols = list(columns) + ([keep_time] if keep_time and keep_time in df.columns else [])
    return df.select(*cols)
