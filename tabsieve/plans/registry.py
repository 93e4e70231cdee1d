"""Registry of catalogued queries: key -> (Spark callable, DuckDB oracle SQL or None).

Oracle helpers below spell the library's shared column semantics in DuckDB
SQL so that each oracle is written once per operator, not per column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


# ------------------------------------------------------------ DuckDB helpers
def dq(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def d_norm(c: str) -> str:
    return rf"regexp_replace(coalesce(CAST({dq(c)} AS VARCHAR), ''), '^\s+|\s+$', '', 'g')"


def d_empty(c: str) -> str:
    return f"lower({d_norm(c)}) IN ('', 'nan', 'none', 'null', 'nat')"


def d_non_empty(c: str) -> str:
    return f"CASE WHEN NOT ({d_empty(c)}) THEN {d_norm(c)} END"


def d_long(source: str, cols: list[str], expr, value_name: str = "value") -> str:
    """UNION ALL unpivot: one (feature, value) row per input row and column."""
    parts = [f"SELECT '{c}' AS feature, {expr(c)} AS {value_name} FROM {source}" for c in cols]
    return " UNION ALL ".join(parts)


def d_value_counts(source: str, cols: list[str]) -> str:
    return (f"SELECT feature, value, count(*) AS cnt FROM ({d_long(source, cols, d_non_empty)}) "
            f"WHERE value IS NOT NULL GROUP BY feature, value")


def d_level_stats(source: str, cols: list[str]) -> str:
    return f"""
    SELECT feature, value AS top_value, cnt AS top_count, non_empty_count, nunique FROM (
      SELECT feature, value, cnt,
             CAST(sum(cnt) OVER (PARTITION BY feature) AS BIGINT) AS non_empty_count,
             count(*) OVER (PARTITION BY feature) AS nunique,
             row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value) AS rn
      FROM ({d_value_counts(source, cols)})) WHERE rn = 1"""
