"""End-to-end pipelines (the reference's two entry points).

``run_analysis`` — load -> profile -> clean -> KPIs -> summaries -> insights.
The cleaned KPI table is the one reuse point: it is written once (into the
shared checkpoint folder, so executor loss does not force a recompute of the
cleaning chain).  All grouped reports share one grouping-sets pass over it.

``run_ml`` — features -> split -> model search -> evaluation -> attribution
-> diagnostics, all as DataFrames over the same KPI table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from adperf.operators import aggregate as A
from adperf.operators import clean as C
from adperf.operators import insights as I
from adperf.operators import profile as P
from adperf.operators.kpi import compute_kpis
from adperf.operators.rollup import Rollups, rollups
from adperf.session import materialize


def build_clean_stages(raw: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """De-duplicated rows, fill values and the KPI table, each written once."""
    from adperf.plans.frames import clean_stages

    st = clean_stages(raw, approx=approx)
    st["kpi"] = materialize(compute_kpis(st["clean"]))
    return st


def report_makers(raw: DataFrame, stages: dict[str, DataFrame], r: Rollups, approx: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """Every analysis report, made on call; grouped ones read the rollups of the KPI table."""
    kpi = stages["kpi"]
    return {
        "profile_shape": lambda: P.shape(raw),
        "profile_missing": lambda: P.missing(raw),
        "profile_duplicates": lambda: P.duplicates(raw, stages["std"]),
        "profile_describe": lambda: P.describe(raw),
        "clean_report": lambda: C.cleaning_report(raw, approx=approx, std=stages["std"], fills=stages["fills"], clean=kpi),
        "overall_summary": lambda: A.overall_summary(r),
        "summary_by_campaign": lambda: A.summarize_by(r, "campaign"),
        "summary_by_channel": lambda: A.summarize_by(r, "channel"),
        "summary_by_device": lambda: A.summarize_by(r, "device"),
        "campaign_spend_revenue": lambda: A.campaign_spend_revenue(r),
        "channel_share": lambda: A.channel_share(r),
        "device_means": lambda: A.device_means(r),
        "roi_by_key": lambda: A.roi_by_key(r),
        "weekly_ctr": lambda: A.weekly_ctr(r),
        "monthly_trend": lambda: A.monthly_trend(r),
        "correlation": lambda: A.correlation(kpi),
        "channel_efficiency": lambda: I.channel_efficiency(r),
        "channel_extremes": lambda: I.channel_extremes(r),
        "campaign_score": lambda: I.campaign_scores(r),
        "campaign_profit": lambda: I.campaign_profit(r),
        "budget": lambda: I.budget_allocation(r),
        "best_device": lambda: I.best_device(r),
        "best_weekday": lambda: I.best_weekday(r),
        "spend_revenue_points": lambda: A.spend_revenue_points(kpi),
        "distinct_values": lambda: A.distinct_values(kpi),
        "device_stats": lambda: I.device_stats(r),
        "weekday_stats": lambda: I.weekday_stats(r),
        "executive_summary": lambda: I.executive_summary(r),
    }


def run_analysis(raw: DataFrame, approx: bool = False, stages: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every analysis report as a DataFrame.

    ``describe`` and the correlation are computed at once (a few rows each), the others when they are read.
    """
    if stages is None:
        # The raw view feeds four profiles and the cleaning chain: read the
        # driver tables and run the fixture join once.
        raw = materialize(raw)
        stages = build_clean_stages(raw, approx=approx)
    # one scan for all grouped reports
    makers = report_makers(raw, stages, rollups(stages["kpi"]), approx)
    return {name: make() for name, make in makers.items()}


def run_ml(kpi: DataFrame, target: str = "high_roi", mode: str = "strict", cv_folds: int = 5,
           n_iter: int | None = None, space: str = "reference", model_path: str | None = None,
           params: dict[str, list[dict]] | None = None) -> dict:
    """Features, search, evaluation, attribution and diagnostics for one target."""
    from adperf.ml.shapley import sampled_shapley
    from adperf.ml.train import (
        TREES, feature_importance, folds_frame, out_of_fold_frame, save_model, scored_frame, times_frame, train_all_models,
    )
    from adperf.ml.trees import tree_shap
    from adperf.operators import attribute as X
    from adperf.operators import diagnostics as D
    from adperf.operators import evaluate as E
    from adperf.operators.features import prepare_features

    spark = kpi.sparkSession
    prep = prepare_features(kpi, target, mode=mode)
    trained = train_all_models(prep, cv_folds=cv_folds, n_iter=n_iter, space=space, params=params)
    scored = materialize(scored_frame(trained))
    task = prep.task_type
    metric = "f1_score" if task == "classification" else "r2_score"
    folds = materialize(folds_frame(trained))
    comparison = E.model_comparison(scored, folds, times_frame(spark, trained), task)
    best_name = E.best_model(comparison, metric).collect()[0]["best_model"]
    best = trained[best_name]
    if model_path:
        save_model(best.model, f"{model_path}/best_model_{target}")
    # Trees exactly, other models by sampling.  Several reports read the attributions: explain once.
    if (task, best_name) in TREES:
        shap = tree_shap(best.model, best.test_rows)
    else:
        shap = sampled_shapley(best.model, best.test_rows, best.train_rows, prep.numeric + prep.categorical, task=task)
    shap = materialize(shap)
    importances = feature_importance(best.model, spark)
    out = {
        "comparison": comparison,
        "best_model": best_name,
        "out_of_fold": out_of_fold_frame(trained),
        "cv_summary": E.cv_summary(folds),
        "cv_box": E.cv_box(folds),
        "importance": E.importance_share(importances),
        "top_importance": E.top_importance(importances),
        "attr_importance": X.importance(shap),
        "attr_bar": X.top_features(shap, 15),
        "attr_direction": X.direction(shap),
        "attr_extremes": X.extremes(shap),
        "attr_top10": X.top_features(shap),
        "attr_summary": X.summary_points(shap),
        "attr_waterfall": X.waterfall(shap),
        "score_order": D.score_order(scored, times_frame(spark, trained), task),
    }
    if task == "classification":
        out["class_distribution"] = A.class_distribution(prep.frame)
        out["accuracy_by_model"] = D.accuracy_by_model(scored)
        out["best_unrounded"] = D.best_unrounded(scored)
        out["confusion"] = E.confusion(scored)
        out["correct_split"] = D.correct_split(scored)
    else:
        out["target_range"] = A.target_range(prep.frame)
        out["residual_band"] = D.residual_band(scored)
        out["pred_vs_actual"] = D.pred_vs_actual(scored)
        out["residual_hist"] = D.residual_hist(scored)
    return out
