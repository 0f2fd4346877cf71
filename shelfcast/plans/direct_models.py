"""Evaluation and future runs of the direct models."""

from __future__ import annotations

import json
import datetime as dt
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DirectConfig
from shelfcast.operators.baselines import baseline_forecast
from shelfcast.operators.blend import best_alpha, blend_grid, blend_with_model, share_grid
from shelfcast.operators.direct import direct_dataset, fit_end, forecast_features, newest_rows
from shelfcast.operators.models import best_rounds, feature_importances, fit_tweedie, fit_two_stage, held_out_curves
from shelfcast.operators.postprocess import apply_rules
from shelfcast.operators.profile import item_profile
from shelfcast.operators.recursive import recursive_forecasts
from shelfcast.operators.scoring import wrmsse, wrmsse_by_item
from shelfcast.operators.selection import select_items
from shelfcast.operators.wide import cover_ids, in_file_order, to_wide
from shelfcast.session import written_table
from shelfcast.sources.tables import TableStore


def choose(profile: DataFrame, cfg: DirectConfig) -> DataFrame:
    return select_items(profile, cfg.strategy, cfg.top_n, cfg.min_active_days, cfg.max_days_since_last_sale)


def _profile(daily: DataFrame, as_of, cfg: DirectConfig) -> DataFrame:
    """The profile as of a day, or of the whole history when it need not be consistent in time."""
    return item_profile(daily, as_of if cfg.time_consistent_profile else None)


def _rules(forecast: DataFrame, daily: DataFrame, train_end, cfg: DirectConfig) -> DataFrame:
    return apply_rules(forecast, daily, train_end, cfg.zero_sundays, cfg.end_of_selling_since)


def _static_of(items: DataFrame, profile: DataFrame) -> DataFrame:
    """The selected items with their statistics of another cut day."""
    return profile.join(items.select("item_code"), "item_code", "left_semi")


@dataclass(frozen=True)
class Evaluation:
    scores: DataFrame  # one row: baseline and hybrid WRMSSE, chosen alpha
    grid: DataFrame  # WRMSSE per alpha
    by_item: DataFrame  # per-item scores of the chosen blend
    forecast: DataFrame  # chosen blend
    model: object


def fit_for(daily: DataFrame, items: DataFrame, profile: DataFrame, fit_day, valid_day, cfg: DirectConfig, family: str):
    """Fit on origins up to ``fit_day``; the newest rows up to ``valid_day`` stop the training early.

    One profile per fit day serves all earlier origins. With ``fit_day`` = ``valid_day`` the validation rows
    overlap the training rows.
    """
    fixed = _static_of(items, profile)
    train = written_table(direct_dataset(daily, fixed, fit_day, cfg))
    held_out = written_table(newest_rows(direct_dataset(daily, fixed, valid_day, cfg, origins_end_offset=cfg.horizon), cfg))
    return fit_tweedie(train, cfg, held_out) if family == "tweedie" else fit_two_stage(train, held_out, cfg)


def evaluate(
    daily: DataFrame, train_end: str | dt.date, cfg: DirectConfig, family: str = "two_stage", run_name: str | None = None
) -> Evaluation:
    """M15 (two_stage) and M11 (tweedie). Fit one horizon earlier, forecast after ``train_end``, pick alpha.

    The caller names the run (the family if not); the scores carry all settings as JSON.

    The two-stage family applies the business rules to baseline and blend; the tweedie family does not.
    """
    fit_day = fit_end(train_end, cfg.horizon)
    profile = _profile(daily, train_end, cfg)
    items = written_table(choose(profile, cfg))
    model = fit_for(daily, items, _profile(daily, fit_day, cfg), fit_day, train_end, cfg, family)
    with_rules = family == "two_stage"

    def ruled(forecast: DataFrame) -> DataFrame:
        return _rules(forecast, daily, train_end, cfg) if with_rules else forecast

    baseline = ruled(baseline_forecast(daily, train_end, "median_56", horizon=cfg.horizon))
    weights = profile.select("item_code", "profit_weight")

    def score(forecast: DataFrame) -> float:
        return wrmsse(wrmsse_by_item(daily, forecast, weights, train_end, cfg.horizon)).first()["wrmsse"]

    baseline_score = score(baseline)
    if cfg.recursive:
        alphas = [step / 20 for step in range(21)]
        tried = written_table(recursive_forecasts(daily, items, model, train_end, cfg, alphas))
        grid = written_table(share_grid(daily, tried, alphas, weights, train_end, cfg.horizon))
        alpha = best_alpha(grid, baseline_score)
        better = not grid.filter(F.col("wrmsse_56") < float(baseline_score)).isEmpty()
        chosen = tried.filter(F.col("alpha") == alpha).drop("alpha") if better else baseline
    else:
        predicted = model.predict(forecast_features(daily, items, train_end, cfg)).select(
            "item_code", "target_date", "horizon", "yhat"
        )
        # Rules only zero cells, so blending ruled forecasts equals ruling the blend.
        predicted = written_table(ruled(predicted))
        grid = written_table(blend_grid(daily, baseline, predicted, weights, train_end, cfg.horizon))
        alpha = best_alpha(grid, baseline_score)
        chosen = blend_with_model(baseline, predicted, alpha) if alpha > 0 else baseline
    by_item = wrmsse_by_item(daily, chosen, weights, train_end, cfg.horizon)
    only_top = wrmsse(wrmsse_by_item(daily, chosen, weights, train_end, cfg.horizon, only_items=items))
    summary = wrmsse(by_item).select(
        F.lit(run_name or family).alias("run_name"),
        F.lit(str(train_end)).alias("train_end"),
        F.lit(json.dumps(asdict(cfg))).alias("settings"),
        F.lit(float(baseline_score)).alias("baseline_wrmsse"),
        F.col("wrmsse").alias("hybrid_wrmsse"),
        only_top.scalar().alias("selected_items_wrmsse"),
        F.lit(float(alpha)).alias("best_alpha"),
        F.lit(json.dumps(best_rounds(model))).alias("best_rounds"),
    )
    return Evaluation(summary, grid, by_item, chosen, model)


def save_evaluation(store: TableStore, name: str, result: Evaluation) -> None:
    """K7. Grid, scores, held-out curves, importances and the chosen forecast of an evaluation."""
    spark = result.scores.sparkSession
    store.save_csv(f"held_out_curves_{name}", held_out_curves(result.model, spark), single_file=True)
    store.save_csv(f"feature_importances_{name}", feature_importances(result.model, spark), single_file=True)
    store.save_csv(f"blend_grid_{name}", result.grid, single_file=True)
    store.save_csv(f"scores_{name}", result.scores, single_file=True)
    store.save_artifact(f"item_scores_{name}", result.by_item)
    store.save_artifact(f"forecast_{name}", result.forecast)


def forecast_future(
    daily: DataFrame, train_end: str | dt.date, cfg: DirectConfig, alphas: list[float], ids: DataFrame | None = None
) -> dict[float, DataFrame]:
    """M16. Fit on all history and forecast the next days, one wide forecast per alpha.

    ``ids`` (with column ``id``) fixes the rows of the result and must be covered completely.
    """
    profile = _profile(daily, train_end, cfg)
    items = written_table(choose(profile, cfg))
    model = fit_for(daily, items, profile, train_end, train_end, cfg, "two_stage")
    if cfg.recursive:
        tried = written_table(recursive_forecasts(daily, items, model, train_end, cfg, [float(a) for a in alphas]))
    else:
        base = baseline_forecast(daily, train_end, "median_56", horizon=cfg.horizon)
        baseline = written_table(_rules(base, daily, train_end, cfg))
        predicted = model.predict(forecast_features(daily, items, train_end, cfg))
        predicted = written_table(predicted.select("item_code", "target_date", "horizon", "yhat"))
    out: dict[float, DataFrame] = {}
    for alpha in alphas:
        if cfg.recursive:
            forecast = tried.filter(F.col("alpha") == float(alpha)).drop("alpha")
        else:
            forecast = _rules(blend_with_model(baseline, predicted, alpha), daily, train_end, cfg)
        wide = to_wide(forecast)
        out[alpha] = in_file_order(cover_ids(ids, wide) if ids is not None else wide)
    return out
