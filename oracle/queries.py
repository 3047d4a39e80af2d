"""Oracle SQL per query name (DuckDB).  Column names match the Spark side."""

from __future__ import annotations

from oracle.sql import BASE, CATS, KPI_SQL, NUMS, R, with_base

Q: dict[str, str] = {}


def q(name: str, tail: str, *ctes: str) -> None:
    Q[name] = (with_base(*ctes) if ctes else BASE) + "\n" + tail


# ----------------------------------------------------------------- sources
q("append_duplicates", "SELECT * FROM ad_facts_raw")
_sample_key = ("md5(concat_ws('|', CAST(CAST(date AS DATE) AS VARCHAR), campaign, channel, device, "
               "CAST(CAST(clicks AS BIGINT) AS VARCHAR)))")
q("sample_exact", f"SELECT * FROM ad_facts_raw ORDER BY {_sample_key}, "
  + ", ".join(f"{c} NULLS FIRST" for c in (
      "date", "campaign", "channel", "device", "impressions", "clicks", "spend", "conversions", "revenue", "bounce_rate",
      "avg_session_duration")) + " LIMIT 1000")

# ---------------------------------------------------------------- cleaning
q("clean_dedup", "SELECT * FROM dedup")
q("clean_standardize", "SELECT * FROM std")
q(
    "impute_values",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS col, {R(f'f_{c}', 6)} AS value_double, CAST(NULL AS VARCHAR) AS value_text FROM fills"
         for c in NUMS]
        + [f"SELECT '{c}' AS col, CAST(NULL AS DOUBLE) AS value_double, f_{c} AS value_text FROM fills"
           for c in CATS]
    ),
)
q("clean_impute", "SELECT * FROM imputed")
q("clean_valid", "SELECT * FROM clean")

_null_counts = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in NUMS + CATS)
_fill_rows = " UNION ALL ".join(
    [f"SELECT 'fill', '{c}', CAST(null_{c} AS BIGINT), f_{c}, CAST(NULL AS VARCHAR) FROM nulls, fills WHERE null_{c} > 0"
     for c in NUMS]
    + [f"SELECT 'fill', '{c}', CAST(null_{c} AS BIGINT), CAST(NULL AS DOUBLE), f_{c} FROM nulls, fills WHERE null_{c} > 0"
       for c in CATS]
)
q(
    "clean_report",
    f"""SELECT * FROM (
SELECT 'input' AS step, CAST(NULL AS VARCHAR) AS column_name, CAST((SELECT count(*) FROM ad_facts_raw) AS BIGINT) AS n,
       CAST(NULL AS DOUBLE) AS fill_value, CAST(NULL AS VARCHAR) AS fill_text
UNION ALL SELECT 'duplicates', NULL, CAST((SELECT count(*) FROM ad_facts_raw) - (SELECT count(*) FROM std) AS BIGINT), NULL, NULL
UNION ALL {_fill_rows}
UNION ALL SELECT 'invalid', NULL, CAST((SELECT count(*) FROM std) - (SELECT count(*) FROM clean) AS BIGINT), NULL, NULL
UNION ALL SELECT 'output', NULL, CAST((SELECT count(*) FROM clean) AS BIGINT), NULL, NULL)""",
    f"nulls AS (SELECT {_null_counts} FROM std)",
)

# ---------------------------------------------------------------- KPIs
q("kpis", "SELECT * FROM kpi")


# ---------------------------------------------------------------- aggregates
def _summary(key: str) -> str:
    means = ", ".join(
        f"{R(f'avg({c})', 4)} AS avg_{c}" for c in ["ctr", "cpc", "conversion_rate", "roas", "roi", "bounce_rate"]
    )
    return f"""SELECT {key},
 CAST(sum(impressions) AS BIGINT) AS total_impressions, CAST(sum(clicks) AS BIGINT) AS total_clicks,
 {R('sum(spend)', 4)} AS total_spend, CAST(sum(conversions) AS BIGINT) AS total_conversions,
 {R('sum(revenue)', 4)} AS total_revenue, {means}, CAST(count(impressions) AS BIGINT) AS record_count
FROM kpi WHERE {key} IS NOT NULL GROUP BY {key}"""


for _k in ("campaign", "channel", "device"):
    q(f"summary_by_{_k}", _summary(_k))

q(
    "overall_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS total_records,
 CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS date_range,
 CAST(sum(impressions) AS BIGINT) AS total_impressions, CAST(sum(clicks) AS BIGINT) AS total_clicks,
 {R('sum(spend)', 2)} AS total_spend, CAST(sum(conversions) AS BIGINT) AS total_conversions,
 {R('sum(revenue)', 2)} AS total_revenue,
 {R('sum(clicks)/nullif(sum(impressions),0)', 6)} AS overall_ctr,
 {R('sum(spend)/nullif(sum(clicks),0)', 4)} AS overall_cpc,
 {R('sum(revenue)/nullif(sum(spend),0)', 4)} AS overall_roas,
 {R('(sum(revenue)-sum(spend))/nullif(sum(spend),0)', 4)} AS overall_roi,
 CAST(count(DISTINCT campaign) AS BIGINT) AS unique_campaigns,
 CAST(count(DISTINCT channel) AS BIGINT) AS unique_channels
FROM kpi""",
)
q(
    "campaign_spend_revenue",
    f"SELECT campaign, {R('sum(spend)', 4)} AS total_spend, {R('sum(revenue)', 4)} AS total_revenue FROM kpi GROUP BY campaign",
)
q(
    "channel_share",
    f"""SELECT channel, {R('sum(spend)', 4)} AS total_spend,
 {R('sum(spend)*100/(SELECT sum(spend) FROM kpi)', 4)} AS spend_share_pct,
 {R('sum(revenue)', 4)} AS total_revenue,
 {R('sum(revenue)*100/(SELECT sum(revenue) FROM kpi)', 4)} AS revenue_share_pct
FROM kpi GROUP BY channel""",
)
q(
    "device_means",
    f"SELECT device, {R('avg(ctr)', 6)} AS avg_ctr, {R('avg(conversion_rate)', 6)} AS avg_conversion_rate, "
    f"{R('avg(roas)', 6)} AS avg_roas FROM kpi GROUP BY device",
)
q(
    "roi_by_key",
    " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, {k} AS key, {R('avg(roi)', 6)} AS avg_roi, "
        f"CAST(avg(roi) >= 0 AS BIGINT) AS is_non_negative FROM kpi GROUP BY {k}"
        for k in ("campaign", "channel")
    ),
)
q(
    "weekly_ctr",
    f"SELECT channel, CAST(date_trunc('week', date) AS DATE) AS week, {R('avg(ctr)*100', 10)} AS ctr_pct "
    "FROM kpi GROUP BY 1, 2",
)
q(
    "monthly_trend",
    f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {R('sum(spend)', 4)} AS total_spend, "
    f"{R('sum(revenue)', 4)} AS total_revenue, CAST(sum(conversions) AS BIGINT) AS total_conversions FROM kpi GROUP BY 1",
)
_CORR = ["impressions", "clicks", "spend", "conversions", "revenue", "bounce_rate", "ctr", "cpc", "roas", "roi"]
q(
    "correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})', 6)} AS corr FROM kpi"
        for i, a in enumerate(_CORR)
        for b in _CORR[: i + 1]
    ),
)
q(
    "spend_revenue_points",
    "SELECT campaign, spend, revenue, CAST(revenue > spend AS BIGINT) AS above_break_even, "
    "(SELECT greatest(max(spend), max(revenue)) FROM kpi) AS break_even_max FROM kpi",
)
q(
    "distinct_values",
    " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS dimension, {k} AS value FROM kpi" for k in CATS),
)

_CLS = {
    "high_roi": "CAST(roi > 0 AS INTEGER)",
    "high_conversion": "CAST(conversions > (SELECT quantile_cont(conversions, 0.5) FROM kpi) AS INTEGER)",
}
q(
    "class_distribution",
    " UNION ALL ".join(
        f"SELECT '{t}' AS target_name, {e} AS label, CAST(count(*) AS BIGINT) AS n FROM kpi GROUP BY 2"
        for t, e in _CLS.items()
    ),
)
q(
    "target_range",
    f"SELECT {R('min(revenue)', 4)} AS target_min, {R('max(revenue)', 4)} AS target_max, "
    f"{R('avg(revenue)', 4)} AS target_mean FROM kpi",
)

# ---------------------------------------------------------------- profiling
RAW_COLS = ["date"] + CATS + NUMS
q("profile_shape", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(RAW_COLS)} AS BIGINT) AS n_columns FROM ad_facts_raw")
q(
    "profile_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing, "
        f"{R(f'count(*) FILTER (WHERE {c} IS NULL)*100.0/count(*)', 2)} AS missing_pct FROM ad_facts_raw"
        for c in RAW_COLS
    ),
)
q(
    "profile_duplicates",
    "SELECT CAST((SELECT count(*) FROM ad_facts_raw) - (SELECT count(*) FROM dedup) AS BIGINT) AS duplicates",
)


def _describe(c: str, is_date: bool) -> str:
    v = f"CAST(date_diff('day', DATE '1970-01-01', {c}) AS DOUBLE)" if is_date else f"CAST({c} AS DOUBLE)"
    std = "CAST(NULL AS DOUBLE)" if is_date else R(f"stddev_samp({v})", 6)
    return (
        f"SELECT '{c}' AS column_name, CAST(count({v}) AS BIGINT) AS count, {R(f'avg({v})', 6)} AS mean, "
        f"{std} AS std, {R(f'min({v})', 6)} AS min, {R(f'quantile_cont({v}, 0.25)', 6)} AS p25, "
        f"{R(f'quantile_cont({v}, 0.5)', 6)} AS p50, {R(f'quantile_cont({v}, 0.75)', 6)} AS p75, "
        f"{R(f'max({v})', 6)} AS max FROM ad_facts_raw"
    )


q("profile_describe", " UNION ALL ".join([_describe(c, False) for c in NUMS] + [_describe("date", True)]))

# ---------------------------------------------------------------- insights
_CH_STATS = f"""ch AS (SELECT channel, sum(spend) AS s, sum(revenue) AS r, sum(clicks) AS k, sum(conversions) AS v,
 avg(ctr) AS a_ctr, avg(cpc) AS a_cpc, avg(roas) AS a_roas, count(spend) AS n,
 {R('sum(revenue)/nullif(sum(spend),0)', 4)} AS roas_actual, {R('sum(revenue)-sum(spend)', 2)} AS profit
 FROM kpi GROUP BY channel)"""
q(
    "channel_efficiency",
    f"""SELECT channel, {R('s', 4)} AS total_spend, {R('r', 4)} AS total_revenue, CAST(k AS BIGINT) AS total_clicks,
 CAST(v AS BIGINT) AS total_conversions, {R('a_ctr', 6)} AS avg_ctr, {R('a_cpc', 6)} AS avg_cpc,
 {R('a_roas', 6)} AS avg_roas, CAST(n AS BIGINT) AS count, roas_actual, profit,
 CASE WHEN roas_actual >= 1.5 THEN 'good' WHEN roas_actual >= 1.0 THEN 'warn' ELSE 'bad' END AS efficiency_band,
 CAST(profit > 0 AS BIGINT) AS is_profitable FROM ch""",
    _CH_STATS,
)
q(
    "channel_extremes",
    f"""SELECT b.channel AS best_channel, {R('b.roas_actual', 2)} AS best_roas,
 w.channel AS worst_channel, {R('w.roas_actual', 2)} AS worst_roas
FROM (SELECT * FROM ch ORDER BY a_roas DESC, channel ASC LIMIT 1) b,
     (SELECT * FROM ch ORDER BY a_roas ASC, channel DESC LIMIT 1) w""",
    _CH_STATS,
)
_CAMP = f"""cg AS (SELECT campaign, sum(spend) AS s, sum(revenue) AS r, sum(conversions) AS v,
  avg(ctr) AS avg_ctr, avg(conversion_rate) AS avg_conversion_rate, avg(roas) AS avg_roas FROM kpi GROUP BY campaign),
cm AS (SELECT max(avg_ctr) AS m1, max(avg_conversion_rate) AS m2, max(avg_roas) AS m3 FROM cg),
cs AS (SELECT cg.*, CASE WHEN m1 > 0 THEN avg_ctr/m1 ELSE 0 END AS n1,
  CASE WHEN m2 > 0 THEN avg_conversion_rate/m2 ELSE 0 END AS n2, CASE WHEN m3 > 0 THEN avg_roas/m3 ELSE 0 END AS n3
  FROM cg, cm),
sc AS (SELECT campaign, {R('s', 4)} AS total_spend, {R('r', 4)} AS total_revenue, CAST(v AS BIGINT) AS total_conversions,
  {R('avg_ctr', 6)} AS avg_ctr, {R('avg_conversion_rate', 6)} AS avg_conversion_rate, {R('avg_roas', 6)} AS avg_roas,
  {R('n1', 6)} AS avg_ctr_norm, {R('n2', 6)} AS avg_conversion_rate_norm, {R('n3', 6)} AS avg_roas_norm,
  {R('n1*0.2 + n2*0.3 + n3*0.5', 4)} AS efficiency_score FROM cs)"""
q("campaign_score", "SELECT * FROM sc", _CAMP)
q(
    "campaign_profit",
    f"""SELECT campaign, total_spend, total_revenue, {R('total_revenue - total_spend', 2)} AS profit,
 CAST(campaign = (SELECT campaign FROM sc ORDER BY efficiency_score DESC, campaign LIMIT 1) AS BIGINT) AS is_top FROM sc""",
    _CAMP,
)
_BUDGET = f"""bg AS (SELECT channel, sum(spend) AS s, sum(revenue) AS r FROM kpi GROUP BY channel),
bg2 AS (SELECT *, {R('r/nullif(s,0)', 4)} AS roas FROM bg),
bt AS (SELECT sum(s) AS total_budget, sum(greatest(roas, 0.0)) AS pos FROM bg2),
b1 AS (SELECT bg2.*, total_budget, {R('s/nullif(total_budget,0)*100', 1)} AS current_pct,
  {R('greatest(roas,0.0)/nullif(pos,0)*100', 1)} AS recommended_pct FROM bg2, bt),
b2 AS (SELECT *, {R('recommended_pct - current_pct', 1)} AS shift_pct FROM b1),
budget AS (SELECT channel, {R('s', 4)} AS total_spend, {R('r', 4)} AS total_revenue, roas, {R('r - s', 4)} AS profit,
  current_pct, recommended_pct, shift_pct, {R('shift_pct/100*total_budget', 0)} AS shift_amount,
  CASE WHEN shift_pct > 0 THEN 'INCREASE' WHEN shift_pct < 0 THEN 'DECREASE' ELSE 'KEEP' END AS direction,
  {R('total_budget', 4)} AS total_budget FROM b2)"""
q("budget", "SELECT * FROM budget", _BUDGET)
q(
    "device_stats",
    f"""SELECT device, {R('sum(spend)', 4)} AS total_spend, {R('sum(revenue)', 4)} AS total_revenue,
 {R('avg(ctr)', 6)} AS avg_ctr, {R('avg(conversion_rate)', 6)} AS avg_conversion_rate, {R('avg(roas)', 6)} AS avg_roas,
 {R('avg(bounce_rate)', 6)} AS avg_bounce, CAST(count(spend) AS BIGINT) AS count,
 {R('sum(revenue)/nullif(sum(spend),0)', 4)} AS roas_actual FROM kpi GROUP BY device""",
)
q(
    "best_device",
    f"""SELECT device AS best_device, {R('r/nullif(s,0)', 4)} AS roas_actual FROM
 (SELECT device, avg(roas) AS a, sum(spend) AS s, sum(revenue) AS r FROM kpi GROUP BY device)
 ORDER BY a DESC, device ASC LIMIT 1""",
)
_WD = "wd AS (SELECT isodow(date)-1 AS w, dayname(date) AS weekday, avg(roas) AS a_roas, avg(ctr) AS a_ctr, sum(conversions) AS v FROM kpi GROUP BY 1, 2)"
q(
    "weekday_stats",
    f"SELECT weekday, CAST(w AS BIGINT) AS weekday_index, {R('a_roas', 6)} AS avg_roas, {R('a_ctr', 6)} AS avg_ctr, "
    "CAST(v AS BIGINT) AS total_conversions FROM wd",
    _WD,
)
q("best_weekday", f"SELECT weekday AS best_day, {R('a_roas', 6)} AS avg_roas FROM wd ORDER BY a_roas DESC, w ASC LIMIT 1", _WD)
q(
    "executive_summary",
    f"""SELECT {R('t.s', 2)} AS total_spend, {R('t.r', 2)} AS total_revenue, {R('t.r - t.s', 2)} AS net_profit,
 {R('(t.r - t.s)/nullif(t.s,0)', 6)} AS overall_roi,
 b.channel AS best_channel, {R('b.roas_actual', 2)} AS best_roas, w.channel AS worst_channel, {R('w.roas_actual', 2)} AS worst_roas,
 (SELECT campaign FROM sc ORDER BY efficiency_score DESC, campaign LIMIT 1) AS top_campaign,
 i.channel AS increase_channel, i.shift_pct AS increase_pct, d.channel AS decrease_channel, d.shift_pct AS decrease_pct,
 (SELECT weekday FROM wd ORDER BY a_roas DESC, w ASC LIMIT 1) AS best_day
FROM (SELECT sum(spend) AS s, sum(revenue) AS r FROM kpi) t,
 (SELECT * FROM ch ORDER BY a_roas DESC, channel ASC LIMIT 1) b,
 (SELECT * FROM ch ORDER BY a_roas ASC, channel DESC LIMIT 1) w,
 (SELECT * FROM budget ORDER BY shift_pct DESC, roas DESC, channel ASC LIMIT 1) i,
 (SELECT * FROM budget ORDER BY shift_pct ASC, roas DESC, channel ASC LIMIT 1) d""",
    _CH_STATS, _CAMP, _BUDGET, _WD,
)

# ---------------------------------------------------------------- features
KPI_COLS = ["date"] + CATS + NUMS + list(KPI_SQL)
DERIVED = {
    "cost_per_conversion": R("CASE WHEN conversions>0 THEN spend/conversions ELSE 0 END", 4),
    "revenue_per_click": R("CASE WHEN clicks>0 THEN revenue/clicks ELSE 0 END", 4),
    "bounce_click_ratio": R("bounce_rate*ln(1+clicks)", 4),
    "impression_conversion_rate": R("CASE WHEN impressions>0 THEN conversions/impressions ELSE 0 END", 8),
}
INTER = {
    "campaign_channel": "campaign || '_' || channel",
    "channel_device": "channel || '_' || device",
    "campaign_device": "campaign || '_' || device",
}
TIME = {
    "day": "CAST(day(date) AS INTEGER)",
    "month": "CAST(month(date) AS INTEGER)",
    "weekday": "CAST(isodow(date)-1 AS INTEGER)",
    "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
    "day_of_year": "CAST(dayofyear(date) AS INTEGER)",
    "week_of_year": "CAST(week(date) AS INTEGER)",
}


def _sel(d: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in d.items())


q("target_high_conversion", f"SELECT *, {_CLS['high_conversion']} AS target FROM kpi")
q("target_revenue", "SELECT *, CAST(revenue AS DOUBLE) AS target FROM kpi")
q("target_high_roi", f"SELECT *, {_CLS['high_roi']} AS target FROM kpi")
q("derived_features", f"SELECT *, {_sel(DERIVED)} FROM kpi")
q("interactions", f"SELECT *, {_sel(INTER)} FROM kpi")
q("time_features", f"SELECT *, {_sel(TIME)} FROM kpi")

FULL_COLS = KPI_COLS + ["target"] + list(DERIVED) + list(INTER) + list(TIME)
_DROP_HIGH_ROI = {"date", "roi", "roas", "revenue", "revenue_per_conversion", "target"}
FEATURES_HIGH_ROI = [c for c in FULL_COLS if c not in _DROP_HIGH_ROI]
_FULL = f"feat AS (SELECT *, {_CLS['high_roi']} AS target, {_sel(DERIVED)}, {_sel(INTER)}, {_sel(TIME)} FROM kpi)"
_KEY = (
    "md5(concat_ws('|', CAST(date AS VARCHAR), campaign, channel, device, CAST(impressions AS VARCHAR), "
    "CAST(clicks AS VARCHAR), CAST(conversions AS VARCHAR), "
    + ", ".join(f"CAST(CAST(round_even({c}*1e4, 0) AS BIGINT) AS VARCHAR)"
                for c in ("spend", "revenue", "bounce_rate", "avg_session_duration"))
    + "))"
)
q("feature_frame", f"SELECT {', '.join(FEATURES_HIGH_ROI)}, target FROM feat", _FULL)
q(
    "split_exact",
    f"""SELECT {', '.join(FEATURES_HIGH_ROI)}, target,
 CAST(row_number() OVER (PARTITION BY target ORDER BY {_KEY}, {', '.join(FULL_COLS)})
      <= (count(*) OVER (PARTITION BY target) * 200000 + 999999) // 1000000 AS INTEGER) AS is_test
FROM feat""",
    _FULL,
)
q(
    "split_hash",
    f"SELECT {', '.join(FEATURES_HIGH_ROI)}, target, CAST(substr({_KEY}, 1, 8) < '33333333' AS INTEGER) AS is_test FROM feat",
    _FULL,
)

# ---------------------------------------------------------------- scorer (FIXTURES F3)
_SPLIT = f"""split AS (SELECT *, {_KEY} AS row_id, CAST(substr({_KEY}, 1, 8) < '33333333' AS INTEGER) AS is_test FROM kpi),
te AS (SELECT * FROM split WHERE is_test = 1),
tr AS (SELECT * FROM split WHERE is_test = 0)"""
_CLF = [("m1", "ctr", "ctr > 0.03"), ("m2", "-cpc", "cpc < 0.5"), ("m3", "conversion_rate", "conversion_rate > 0.02")]
_REG = [("r1", "spend*1.2"), ("r2", "CAST(conversions AS DOUBLE)*30.0"), ("r3", "25.0")]
_SCC = "scc AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{m}' AS model, CAST(roi > 0 AS INTEGER) AS label, CAST({p} AS INTEGER) AS prediction, "
    f"CAST({s} AS DOUBLE) AS score FROM te" for m, s, p in _CLF) + ")"
_SCR = "scr AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{m}' AS model, CAST(revenue AS DOUBLE) AS label, CAST({p} AS DOUBLE) AS prediction FROM te"
    for m, p in _REG) + ")"
_FOLDS = "folds AS (SELECT model, fold, avg(CAST(label = prediction AS DOUBLE)) AS score FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, CAST(instr('0123456789abcdef', substr(row_id, 9, 1)) % 5 AS INTEGER) AS fold, "
    f"CAST(roi > 0 AS INTEGER) AS label, CAST({p} AS INTEGER) AS prediction FROM tr" for m, s, p in _CLF) + ") GROUP BY 1, 2)"
_TIMES = "times AS (SELECT * FROM (VALUES ('m1', CAST(1.0 AS DOUBLE)), ('m2', CAST(2.0 AS DOUBLE)), ('m3', CAST(3.0 AS DOUBLE))) t(model, train_time_s))"
_CM = """cnt AS (SELECT model, label, prediction, count(*) AS n FROM scc GROUP BY 1, 2, 3),
sup AS (SELECT model, label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cnt GROUP BY 1, 2),
prd AS (SELECT model, prediction AS cls, sum(n) AS predicted FROM cnt GROUP BY 1, 2),
pc AS (SELECT s.model, s.cls, CAST(support AS DOUBLE) AS support, CAST(tp AS DOUBLE) AS tp,
  CASE WHEN coalesce(predicted, 0) > 0 THEN CAST(tp AS DOUBLE)/predicted ELSE 0 END AS p,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE)/support ELSE 0 END AS r FROM sup s LEFT JOIN prd USING (model, cls)),
pcf AS (SELECT *, CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0 END AS f FROM pc),
cm AS (SELECT model, sum(tp)/sum(support) AS accuracy, sum(p*support)/sum(support) AS precision,
  sum(r*support)/sum(support) AS recall, sum(f*support)/sum(support) AS f1_score FROM pcf GROUP BY model)"""
_AUC = """ra AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
   + (count(*) OVER (PARTITION BY model, score) - 1) / CAST(2 AS DOUBLE) AS ar FROM scc),
auc AS (SELECT model, (sum(ar) FILTER (WHERE label = 1)
   - CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
   / nullif(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label <> 1), 0) AS roc_auc
  FROM ra GROUP BY model)"""
_RM = """rm AS (SELECT model, sqrt(avg((label - prediction)*(label - prediction))) AS rmse, avg(abs(label - prediction)) AS mae,
  1 - sum((label - prediction)*(label - prediction)) / nullif(count(*)*var_pop(label), 0) AS r2_score FROM scr GROUP BY model)"""
_CV = f"cv AS (SELECT model, {R('avg(score)', 4)} AS cv_mean, {R('stddev_pop(score)', 4)} AS cv_std FROM folds GROUP BY model)"
_W = {"ctr": 2.0, "cpc": -0.5, "conversion_rate": 1.0, "bounce_rate": -0.25, "spend": 0.01}
_IMP = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({abs(w)} AS DOUBLE) * stddev_pop(CAST({c} AS DOUBLE)) AS importance FROM tr"
    for c, w in _W.items()) + ")"
_IMPS = f"""imps AS (SELECT feature, {R('importance', 6)} AS importance,
  CASE WHEN (SELECT sum(importance) FROM imp) > 0 THEN {R('importance/(SELECT sum(importance) FROM imp)*100', 2)} END AS importance_pct FROM imp)"""
_MU = "mu AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}" for c in _W) + " FROM tr)"
_ATTR = "attr AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, CAST({w} AS DOUBLE) * (CAST({c} AS DOUBLE) - mu_{c}) AS shap, "
    f"CAST({c} AS DOUBLE) AS feature_value FROM te, mu" for c, w in _W.items()) + ")"
_FS = """fs AS (SELECT feature, avg(abs(shap)) AS mas, avg(shap) AS ms FROM attr GROUP BY feature),
fi AS (SELECT feature, mas, ms, CASE WHEN (SELECT sum(mas) FROM fs) > 0
  THEN """ + R("mas/(SELECT sum(mas) FROM fs)*100", 2) + """ ELSE 0 END AS importance_pct FROM fs)"""
_CLS_BASE = (_SPLIT, _SCC)
_REG_BASE = (_SPLIT, _SCR)
_ATTR_BASE = (_SPLIT, _MU, _ATTR, _FS)

q("zscore", "SELECT row_id, " + ", ".join(
    f"{R(f'(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM tr)) / nullif((SELECT stddev_pop({c}) FROM tr), 0)', 6)} AS z_{c}"
    for c in ["impressions", "clicks", "spend", "conversions", "bounce_rate", "avg_session_duration", "ctr", "cpc", "cpm",
              "conversion_rate"]) + " FROM tr", _SPLIT)
_RARE_COLS = {"campaign": "campaign", "channel": "channel", "device": "device", **INTER}
q("rare_categories", " UNION ALL ".join(
    f"SELECT '{k}' AS feature, {v} AS value, CAST(count(*) AS BIGINT) AS n, "
    f"CASE WHEN count(*) >= 2 THEN {v} ELSE '__infrequent__' END AS level FROM tr GROUP BY {v}"
    for k, v in _RARE_COLS.items()), _SPLIT)
q("cv_summary", "SELECT * FROM cv", _SPLIT, _FOLDS, _CV)
q("importance_share", "SELECT * FROM imps", _SPLIT, _IMP, _IMPS)
q("classification_metrics", "SELECT model, " + ", ".join(
    f"{R(c, 4)} AS {c}" for c in ("accuracy", "precision", "recall", "f1_score")) + " FROM cm", *_CLS_BASE, _CM)
q("roc_auc", f"SELECT model, {R('roc_auc', 4)} AS roc_auc FROM auc", *_CLS_BASE, _AUC)
q("regression_metrics", "SELECT model, " + ", ".join(f"{R(c, 4)} AS {c}" for c in ("rmse", "mae", "r2_score")) + " FROM rm",
  *_REG_BASE, _RM)
_COMP = "comp AS (SELECT cm.model, " + ", ".join(
    f"{R(c, 4)} AS {c}" for c in ("accuracy", "precision", "recall", "f1_score")) + f""", {R('roc_auc', 4)} AS roc_auc,
  cv_mean, cv_std, train_time_s FROM cm LEFT JOIN auc USING (model) LEFT JOIN cv USING (model) LEFT JOIN times USING (model))"""
_COMP_BASE = (*_CLS_BASE, _CM, _AUC, _FOLDS, _CV, _TIMES, _COMP)
q("model_comparison", "SELECT * FROM comp", *_COMP_BASE)
q("best_model", "SELECT model AS best_model, f1_score AS score FROM comp ORDER BY f1_score DESC, model LIMIT 1", *_COMP_BASE)
q("confusion", """SELECT m.model, l.label, p.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT model FROM scc) m CROSS JOIN (SELECT CAST(range AS INTEGER) AS label FROM range(2)) l
CROSS JOIN (SELECT CAST(range AS INTEGER) AS prediction FROM range(2)) p
LEFT JOIN (SELECT model, label, prediction, count(*) AS n FROM scc GROUP BY 1, 2, 3) c
  ON c.model = m.model AND c.label = l.label AND c.prediction = p.prediction""", *_CLS_BASE)
q("cv_box", f"""SELECT model, {R('min(score)', 6)} AS min, {R('quantile_cont(score, 0.25)', 6)} AS q1,
 {R('quantile_cont(score, 0.5)', 6)} AS median, {R('quantile_cont(score, 0.75)', 6)} AS q3, {R('max(score)', 6)} AS max,
 {R('avg(score)', 6)} AS mean FROM folds GROUP BY model""", _SPLIT, _FOLDS)
q("top_importance", "SELECT * FROM imps WHERE importance_pct IS NOT NULL ORDER BY importance DESC, feature LIMIT 15",
  _SPLIT, _IMP, _IMPS)

q("linear_attribution", f"SELECT row_id, feature, {R('shap', 8)} AS shap, feature_value FROM attr", _SPLIT, _MU, _ATTR)
q("shapley_linear", " UNION ALL ".join(
    f"SELECT CASE WHEN n = 1 THEN row_id ELSE row_id || '#' || n END AS row_id, '{c}' AS feature, "
    f"{R(f'CAST({w} AS DOUBLE) * (CAST({c} AS DOUBLE) - (SELECT CAST({c} AS DOUBLE) FROM tr ORDER BY row_id LIMIT 1))', 6)} AS shap, "
    f"CAST({c} AS DOUBLE) AS feature_value FROM twice" for c, w in _W.items()), _SPLIT,
  "twice AS (SELECT *, row_number() OVER (PARTITION BY row_id) AS n FROM (SELECT * FROM te UNION ALL SELECT * FROM te WHERE clicks % 10 = 0))")
_BAND = "CASE WHEN importance_pct >= 10 THEN 'high' WHEN importance_pct >= 5 THEN 'medium' ELSE 'low' END"
q("attr_importance", f"SELECT feature, {R('mas', 6)} AS mean_abs_shap, importance_pct, {_BAND} AS band FROM fi", *_ATTR_BASE)
q("attr_direction", f"SELECT feature, {R('ms', 6)} AS mean_shap, CASE WHEN ms > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM fs",
  *_ATTR_BASE)
q("attr_extremes", f"""SELECT * FROM (SELECT 'positive' AS side, feature, {R('ms', 6)} AS mean_shap FROM fs WHERE ms > 0 ORDER BY ms DESC, feature LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'negative' AS side, feature, {R('ms', 6)} AS mean_shap FROM fs WHERE ms < 0 ORDER BY ms ASC, feature LIMIT 5)""",
  *_ATTR_BASE)
q("attr_top10", f"SELECT feature, {R('mas', 6)} AS mean_abs_shap, importance_pct, {_BAND} AS band FROM fi "
  f"ORDER BY {R('mas', 6)} DESC, feature LIMIT 10", *_ATTR_BASE)
q("attr_summary", f"""SELECT a.row_id, a.feature, {R('a.shap', 6)} AS shap,
 {R('CASE WHEN b.vmax > b.vmin THEN (a.feature_value - b.vmin)/(b.vmax - b.vmin) ELSE 0.5 END', 6)} AS norm_value
FROM attr a JOIN (SELECT feature, min(feature_value) AS vmin, max(feature_value) AS vmax FROM attr GROUP BY feature) b USING (feature)
WHERE a.feature IN (SELECT feature FROM fi ORDER BY {R('mas', 6)} DESC, feature LIMIT 15)""", *_ATTR_BASE)
q("attr_waterfall", f"""SELECT row_id, feature, {R('shap', 6)} AS shap, CASE WHEN shap > 0 THEN 'up' ELSE 'down' END AS effect
FROM attr WHERE row_id = (SELECT row_id FROM attr GROUP BY row_id ORDER BY sum(abs(shap)) DESC, row_id LIMIT 1)
ORDER BY abs(shap) DESC, feature LIMIT 12""", *_ATTR_BASE)

q("best_unrounded", f"SELECT model AS best_model, {R('f1_score', 6)} AS score FROM cm ORDER BY f1_score DESC, model LIMIT 1",
  *_CLS_BASE, _CM)
_BESTR = "bestr AS (SELECT * FROM scr WHERE model = (SELECT model FROM rm ORDER BY r2_score DESC, model LIMIT 1))"
q("pred_vs_actual", f"""SELECT model, label AS actual, prediction AS predicted,
 (SELECT least(min(label), min(prediction)) FROM bestr) AS lim_lo, (SELECT greatest(max(label), max(prediction)) FROM bestr) AS lim_hi,
 (SELECT {R('r2_score', 6)} FROM rm WHERE rm.model = bestr.model) AS r2, (SELECT {R('rmse', 6)} FROM rm WHERE rm.model = bestr.model) AS rmse
FROM bestr""", *_REG_BASE, _RM, _BESTR)
q("residual_band", f"""SELECT first(model) AS model, {R('first(sd)', 6)} AS residual_std, {R('-2*first(sd)', 6)} AS band_lo,
 {R('2*first(sd)', 6)} AS band_hi, CAST(count(*) FILTER (WHERE abs(label - prediction) > 2*sd) AS BIGINT) AS outliers,
 CAST(count(*) AS BIGINT) AS total
FROM bestr, (SELECT stddev_pop(label - prediction) AS sd FROM bestr)""", *_REG_BASE, _RM, _BESTR)
q("residual_hist", f"""SELECT g.bin, {R('st.rmin + g.bin*st.w', 6)} AS edge_lo, {R('st.rmin + (g.bin + 1)*st.w', 6)} AS edge_hi,
 CAST(coalesce(c.n, 0) AS BIGINT) AS n, {R('st.rmean', 6)} AS mean, {R('st.rstd', 6)} AS std
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g CROSS JOIN st
LEFT JOIN (SELECT CAST(CASE WHEN w > 0 THEN least(floor((label - prediction - rmin)/w), 29) ELSE 0 END AS INTEGER) AS bin,
  count(*) AS n FROM bestr, st GROUP BY 1) c ON c.bin = g.bin""",
  *_REG_BASE, _RM, _BESTR,
  "st AS (SELECT min(label - prediction) AS rmin, max(label - prediction) AS rmax, avg(label - prediction) AS rmean, "
  "stddev_pop(label - prediction) AS rstd, (max(label - prediction) - min(label - prediction))/30 AS w FROM bestr)")
_BESTC = "bestc AS (SELECT * FROM scc WHERE model = (SELECT model FROM cm ORDER BY f1_score DESC, model LIMIT 1))"
q("correct_split", f"""SELECT CASE WHEN label = prediction THEN 'correct' ELSE 'incorrect' END AS outcome, CAST(count(*) AS BIGINT) AS n,
 {R('count(*)*100.0/(SELECT count(*) FROM bestc)', 4)} AS pct FROM bestc GROUP BY 1""", *_CLS_BASE, _CM, _BESTC)
q("accuracy_by_model", f"SELECT model, {R('avg(CAST(label = prediction AS DOUBLE))', 6)} AS accuracy FROM scc GROUP BY model",
  *_CLS_BASE)
q("score_order", f"SELECT model, {R('f1_score', 6)} AS score, train_time_s FROM cm LEFT JOIN times USING (model)",
  *_CLS_BASE, _CM, _TIMES)


# ------------------------------------------------------------ trained models
def _train_sql(name: str, target: str, stratified: bool, draws: int) -> str:
    """Row counts of the exact split; every fit must have whole, sane predictions that beat a constant."""
    split = (
        f"SELECT CAST(sum((n * 200000 + 999999) // 1000000) AS BIGINT) AS te, CAST(sum(n) AS BIGINT) AS n FROM ({n_rows(target, stratified)})"
    )
    return f"""SELECT '{name}' AS model, te AS n_test, (n - te) * {draws} AS n_out_of_fold, CAST({draws} AS BIGINT) AS n_draws,
 CAST(5 AS BIGINT) AS n_folds, CAST(0 AS BIGINT) AS bad_test, CAST(0 AS BIGINT) AS bad_out_of_fold,
 TRUE AS test_beats_constant, TRUE AS folds_beat_constant FROM ({split})"""


def n_rows(target: str, stratified: bool) -> str:
    label = {"high_roi": "roi > 0", "high_conversion": "conversions > (SELECT quantile_cont(conversions, 0.5) FROM kpi)", "revenue": "1"}[target]
    return f"SELECT count(*) AS n FROM kpi GROUP BY {label if stratified else '1 = 1'}"


for _n, _m, _t, _d in (
    ("train_logistic", "Logistic Regression", "high_roi", 20), ("train_ridge", "Ridge Regression", "revenue", 20),
    ("train_forest_classifier", "Random Forest", "high_conversion", 1), ("train_boosted_classifier", "Gradient Boosting", "high_roi", 1),
    ("train_forest_regressor", "Random Forest", "revenue", 1), ("train_boosted_regressor", "Gradient Boosting", "revenue", 1),
):
    q(_n, _train_sql(_m, _t, _t != "revenue", _d))

# raw columns of a high_roi model in strict mode: FEATURES_HIGH_ROI without the label's restatement
q("tree_attribution", f"""SELECT CAST(sum((n * 200000 + 999999) // 1000000) AS BIGINT) AS n_rows, CAST({len(FEATURES_HIGH_ROI) - 1} AS BIGINT) AS fewest_features,
 CAST({len(FEATURES_HIGH_ROI) - 1} AS BIGINT) AS most_features, TRUE AS additive FROM ({n_rows("high_roi", True)})""")

# Two scaled columns: the normal equations have the diagonal n + alpha and the off-diagonal n r.
q("ridge_coefficients", f"""SELECT fold, alpha, {R('w1 / s1', 6)} AS w_spend, {R('w2 / s2', 6)} AS w_clicks, {R('my - w1 / s1 * m1 - w2 / s2 * m2', 6)} AS intercept
FROM (SELECT *, ((n + alpha) * c1 - n * r * c2) / ((n + alpha) ** 2 - (n * r) ** 2) AS w1, ((n + alpha) * c2 - n * r * c1) / ((n + alpha) ** 2 - (n * r) ** 2) AS w2
      FROM (SELECT f.fold, count(*) AS n, avg(spend) AS m1, avg(clicks) AS m2, avg(revenue) AS my, stddev_pop(spend) AS s1, stddev_pop(clicks) AS s2,
                   corr(spend, clicks) AS r, count(*) * covar_pop(spend, revenue) / stddev_pop(spend) AS c1, count(*) * covar_pop(clicks, revenue) / stddev_pop(clicks) AS c2
            FROM (SELECT *, (instr('0123456789abcdef', substr(row_id, 9, 1)) % 5) AS fold FROM tr) t
            JOIN (SELECT CAST(unnest([-1, 0, 1, 2, 3, 4]) AS INTEGER) AS fold) f ON t.fold <> f.fold GROUP BY f.fold)
      CROSS JOIN (SELECT CAST(unnest([0.5, 20.0, 3000.0]) AS DOUBLE) AS alpha))""", _SPLIT)

# the same columns, whether the ratios were there or had to be made
Q["derived_from_base"] = Q["derived_features"]
Q["attr_bar"] = Q["attr_top10"].replace("LIMIT 10", "LIMIT 15")
