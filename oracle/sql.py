"""DuckDB oracle SQL: a shared CTE (raw -> clean -> kpi) plus one tail per query.

Written independently of the Spark code, in DuckDB's dialect (FIXTURES.md F6):
``quantile_cont`` medians, ``GROUP BY ... ORDER BY count DESC, value`` modes,
``trunc`` before integer casts, ``round_even`` for NumPy rounding.
"""

from __future__ import annotations


def R(expr: str, d: int) -> str:
    """NumPy rounding in DuckDB."""
    return f"(round_even(CAST(({expr}) AS DOUBLE)*1e{d},0)/1e{d})"


def T1(c: str) -> str:
    """Letter-run title case with whitespace strip."""
    return (
        f"coalesce(list_aggregate(list_transform(regexp_extract_all(regexp_replace({c},'^\\s+|\\s+$','','g'),"
        f" '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda x: upper(x[1])||lower(x[2:])), 'string_agg', ''),"
        f" CASE WHEN {c} IS NOT NULL THEN '' END)"
    )


NUMS = ["impressions", "clicks", "spend", "conversions", "revenue", "bounce_rate", "avg_session_duration"]
CATS = ["campaign", "channel", "device"]
INTS = ["impressions", "clicks", "conversions"]


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _imputed_col(c: str) -> str:
    if c in INTS:
        return f"CAST(trunc(coalesce({c}, f_{c})) AS BIGINT) AS {c}"
    return f"CAST(coalesce({c}, f_{c}) AS DOUBLE) AS {c}"


RAW_CTE = """
r0 AS (
 SELECT CAST(l.l_shipdate AS DATE) AS date,
  CASE WHEN (l.l_orderkey*7+l.l_linenumber)%60=7 THEN upper(p.p_brand) ELSE p.p_brand END AS campaign,
  CASE WHEN (l.l_orderkey+l.l_partkey)%97=5 THEN NULL ELSE c.c_mktsegment END AS channel,
  CASE l.l_returnflag WHEN 'A' THEN ' mobile' WHEN 'N' THEN 'Desktop' ELSE 'tablet ' END AS device,
  CASE WHEN l.l_orderkey%33=0 THEN NULL ELSE CAST(floor(l.l_extendedprice/10) AS DOUBLE) END AS impressions,
  CASE WHEN l.l_orderkey%31=0 THEN NULL ELSE l.l_quantity*l.l_linenumber END AS clicks,
  CASE WHEN l.l_partkey%37=0 THEN NULL ELSE l.l_quantity*(l.l_partkey%250)/100 END AS spend,
  CASE WHEN l.l_partkey%29=0 THEN NULL ELSE CAST(floor(l.l_quantity*l.l_tax) AS DOUBLE) END AS conversions,
  CASE WHEN l.l_suppkey%41=0 THEN NULL
       ELSE CAST(floor(l.l_quantity*l.l_tax)*(l.l_partkey%75)*(1+length(c.c_mktsegment)%4) AS DOUBLE) END AS revenue,
  CASE WHEN l.l_orderkey%43=0 THEN NULL ELSE l.l_discount*11 END AS bounce_rate,
  l.l_quantity*12 AS avg_session_duration
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
 JOIN customer c ON o.o_custkey=c.c_custkey JOIN part p ON l.l_partkey=p.p_partkey),
ad_facts_raw AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE clicks%100=0)"""

_std_cols = ", ".join(
    ["date"] + [f"{T1(c)} AS {c}" for c in CATS] + NUMS
)
_fill_cols = ", ".join(
    [f"quantile_cont({c}, 0.5) AS f_{c}" for c in NUMS] + [f"{_mode(c)} AS f_{c}" for c in CATS]
)
_imputed_cols = ", ".join(
    ["date"] + [f"coalesce({c}, f_{c}) AS {c}" for c in CATS] + [_imputed_col(c) for c in NUMS]
)

KPI_SQL = {
    "ctr": R("CASE WHEN impressions>0 THEN clicks/impressions ELSE 0 END", 6),
    "cpc": R("CASE WHEN clicks>0 THEN spend/clicks ELSE 0 END", 4),
    "cpm": R("CASE WHEN impressions>0 THEN (spend/impressions)*1000 ELSE 0 END", 4),
    "conversion_rate": R("CASE WHEN clicks>0 THEN conversions/clicks ELSE 0 END", 6),
    "roas": R("CASE WHEN spend>0 THEN revenue/spend ELSE 0 END", 4),
    "roi": R("CASE WHEN spend>0 THEN (revenue-spend)/spend ELSE 0 END", 4),
    "revenue_per_conversion": R("CASE WHEN conversions>0 THEN revenue/conversions ELSE 0 END", 2),
}

BASE = f"""WITH {RAW_CTE},
dedup AS (SELECT DISTINCT * FROM ad_facts_raw),
std AS (SELECT {_std_cols} FROM dedup),
fills AS (SELECT {_fill_cols} FROM std),
imputed AS (SELECT {_imputed_cols} FROM std CROSS JOIN fills),
clean AS (SELECT * FROM imputed WHERE clicks <= impressions AND spend >= 0 AND impressions >= 0
          AND clicks >= 0 AND bounce_rate >= 0 AND bounce_rate <= 1),
kpi AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in KPI_SQL.items())} FROM clean)"""


def with_base(*extra_ctes: str) -> str:
    """BASE plus more CTEs (each ``name AS (...)``)."""
    if not extra_ctes:
        return BASE
    return BASE + ",\n" + ",\n".join(extra_ctes)
