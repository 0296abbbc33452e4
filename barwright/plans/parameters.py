"""Default parameters: feature lists, projections and column groups. A YAML file can replace any of them."""

from __future__ import annotations

from pathlib import Path
from typing import Any


# Features of the bars of stocks, of the market and of the fear index, in order.
STOCK_FEATURES = [
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 1}},
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 2}},
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 3}},
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 5}},
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 10}},
    {"function": "create_log_return_lag_feature", "kwargs": {"lag": 20}},
    {"function": "create_log_distance_from_sma_feature", "kwargs": {"window_size": 5}},
    {"function": "create_log_distance_from_sma_feature", "kwargs": {"window_size": 10}},
    {"function": "create_log_distance_from_sma_feature", "kwargs": {"window_size": 20}},
    {"function": "create_log_distance_from_sma_feature", "kwargs": {"window_size": 50}},
    {"function": "create_ema_crossover_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_ema_crossover_feature", "kwargs": {"short_span": 12, "long_span": 26}},
    {"function": "create_log_return_volatility_feature", "kwargs": {"window_size": 5}},
    {"function": "create_log_return_volatility_feature", "kwargs": {"window_size": 10}},
    {"function": "create_log_return_volatility_feature", "kwargs": {"window_size": 20}},
    {"function": "create_bollinger_bands_features", "kwargs": {"window_size": 10}},
    {"function": "create_bollinger_bands_features", "kwargs": {"window_size": 20}},
    {"function": "create_rsi_feature", "kwargs": {"window_size": 7}},
    {"function": "create_rsi_feature", "kwargs": {"window_size": 14}},
    {"function": "create_rsi_feature", "kwargs": {"window_size": 21}},
    {"function": "create_garman_klass_variance_feature", "kwargs": {"lag": 1}},
    {"function": "create_garman_klass_variance_feature", "kwargs": {"lag": 5}},
    {"function": "create_gk_variance_rolling_mean_feature", "kwargs": {"window_size": 5, "lag": 1}},
    {"function": "create_gk_variance_rolling_mean_feature", "kwargs": {"window_size": 20, "lag": 1}},
    {"function": "create_gk_regime_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_gk_regime_feature", "kwargs": {"short_span": 10, "long_span": 60}},
    {"function": "create_gk_regime_feature", "kwargs": {"short_span": 20, "long_span": 60}},
    {"function": "create_parkinson_variance_feature", "kwargs": {"lag": 1}},
    {"function": "create_parkinson_variance_feature", "kwargs": {"lag": 5}},
    {"function": "create_parkinson_variance_rolling_mean_feature", "kwargs": {"window_size": 20, "lag": 1}},
    {"function": "create_parkinson_regime_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_parkinson_regime_feature", "kwargs": {"short_span": 10, "long_span": 60}},
    {"function": "create_parkinson_regime_feature", "kwargs": {"short_span": 20, "long_span": 60}},
    {"function": "create_parkinson_volatility_feature", "kwargs": {"window_size": 5, "lag": 1}},
    {"function": "create_parkinson_volatility_feature", "kwargs": {"window_size": 20, "lag": 1}},
    {"function": "create_rogers_satchell_variance_feature", "kwargs": {"lag": 1}},
    {"function": "create_rogers_satchell_variance_feature", "kwargs": {"lag": 5}},
    {"function": "create_rogers_satchell_variance_rolling_mean_feature", "kwargs": {"window_size": 20, "lag": 1}},
    {"function": "create_rogers_satchell_regime_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_rogers_satchell_regime_feature", "kwargs": {"short_span": 10, "long_span": 60}},
    {"function": "create_rogers_satchell_regime_feature", "kwargs": {"short_span": 20, "long_span": 60}},
    {"function": "create_rogers_satchell_volatility_feature", "kwargs": {"window_size": 5, "lag": 1}},
    {"function": "create_rogers_satchell_volatility_feature", "kwargs": {"window_size": 20, "lag": 1}},
    {"function": "create_yang_zhang_variance_feature", "kwargs": {"lag": 1}},
    {"function": "create_yang_zhang_variance_rolling_mean_feature", "kwargs": {"lag": 1, "window_size": 5}},
    {"function": "create_yang_zhang_variance_rolling_mean_feature", "kwargs": {"lag": 1, "window_size": 20}},
    {"function": "create_yang_zhang_regime_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_yang_zhang_regime_feature", "kwargs": {"short_span": 10, "long_span": 60}},
    {"function": "create_yang_zhang_regime_feature", "kwargs": {"short_span": 20, "long_span": 60}},
    {"function": "create_yang_zhang_volatility_feature", "kwargs": {"lag": 1, "window_size": 5}},
    {"function": "create_yang_zhang_volatility_feature", "kwargs": {"lag": 1, "window_size": 20}},
    {"function": "create_yang_zhang_volatility_feature", "kwargs": {"lag": 1, "window_size": 60}},
    {"function": "create_yang_zhang_volatility_ratio_feature", "kwargs": {"short_span": 5, "long_span": 20}},
    {"function": "create_yang_zhang_volatility_ratio_feature", "kwargs": {"short_span": 12, "long_span": 26}},
    {"function": "create_yang_zhang_volatility_ratio_feature", "kwargs": {"short_span": 20, "long_span": 60}},
    {"function": "create_daily_range_feature"},
    {"function": "create_range_percentage_feature"},
    {"function": "create_candle_body_feature"},
    {"function": "create_upper_shadow_feature"},
    {"function": "create_lower_shadow_feature"},
    {"function": "create_body_percentage_feature"},
    {"function": "create_upper_shadow_percentage_feature"},
    {"function": "create_lower_shadow_percentage_feature"},
    {"function": "create_volume_pct_change_feature", "kwargs": {"lag": 1}},
    {"function": "create_relative_volume_feature", "kwargs": {"window_size": 5}},
    {"function": "create_relative_volume_feature", "kwargs": {"window_size": 20}},
    {"function": "create_volume_sma_feature", "kwargs": {"window_size": 20}},
    {"function": "create_return_x_volume_feature"},
    {"function": "create_drawdown_feature", "kwargs": {"window_size": 10}},
    {"function": "create_drawdown_feature", "kwargs": {"window_size": 20}},
    {"function": "create_drawdown_feature", "kwargs": {"window_size": 50}},
    {"function": "create_rolling_window_mdd_feature", "kwargs": {"window_size": 10}},
    {"function": "create_rolling_window_mdd_feature", "kwargs": {"window_size": 20}},
    {"function": "create_rolling_window_mdd_feature", "kwargs": {"window_size": 50}},
    {"function": "create_rolling_sharpe_ratio_feature", "kwargs": {"window_size": 10}},
    {"function": "create_rolling_sharpe_ratio_feature", "kwargs": {"window_size": 20}},
    {"function": "create_momentum_feature", "kwargs": {"lag": 1}},
    {"function": "create_momentum_feature", "kwargs": {"lag": 10}},
    {"function": "create_date_features"},
    {"function": "create_market_movement_target"},
]
SPY_FEATURES = [
    {"function": "create_spy_lag_return_feature", "kwargs": {"lag": 1}},
    {"function": "create_spy_lag_return_feature", "kwargs": {"lag": 5}},
    {"function": "create_spy_lag_return_feature", "kwargs": {"lag": 20}},
    {"function": "create_spy_volatility_feature", "kwargs": {"window_size": 20}},
    {"function": "create_spy_drawdown_feature", "kwargs": {"window_size": 252}},
    {"function": "create_spy_sma_ratio_feature", "kwargs": {"window_size": 50}},
    {"function": "create_spy_sma_ratio_feature", "kwargs": {"window_size": 200}},
    {"function": "create_spy_return_zscore_feature", "kwargs": {"window_size": 252}},
]
VIX_FEATURES = [
    {"function": "create_vix_lag_return_feature", "kwargs": {"lag": 1}},
    {"function": "create_vix_lag_return_feature", "kwargs": {"lag": 5}},
    {"function": "create_vix_lag_return_feature", "kwargs": {"lag": 20}},
    {"function": "create_vix_sma_feature", "kwargs": {"window_size": 10}},
    {"function": "create_vix_sma_feature", "kwargs": {"window_size": 20}},
    {"function": "create_vix_sma_feature", "kwargs": {"window_size": 60}},
    {"function": "create_vix_percentile_feature", "kwargs": {"window_size": 252}},
    {"function": "create_vix_level_feature"},
]
TARGET_FUNCTION = "create_market_movement_target"

# The columns of each model's frame, in order.
LR_FEATURES = (
    "Ticker",
    "log_return_lag_1",
    "log_return_lag_5",
    "log_return_lag_10",
    "log_return_lag_20",
    "log_distance_close_vs_SMA_5",
    "log_distance_close_vs_SMA_10",
    "log_distance_close_vs_SMA_20",
    "log_return_volatility_5",
    "log_return_volatility_10",
    "log_return_volatility_20",
    "bollinger_upper_distance_20",
    "bollinger_lower_distance_20",
    "bollinger_bandwidth_20",
    "rsi_14",
    "range_percentage",
    "body_percentage",
    "upper_shadow_pct",
    "lower_shadow_pct",
    "volume_pct_change_1",
    "relative_volume_5",
    "relative_volume_20",
    "drawdown_20",
    "sharpe_20",
    "gk_variance_mean_5_lag_1",
    "gk_variance_mean_20_lag_1",
    "gk_regime_5_20",
    "gk_regime_10_60",
    "gk_regime_20_60",
    "parkinson_regime_5_20",
    "parkinson_regime_10_60",
    "parkinson_regime_20_60",
    "parkinson_volatility_5_lag_1",
    "parkinson_volatility_20_lag_1",
    "parkinson_vol_of_vol_5_lag_1",
    "parkinson_vol_of_vol_20_lag_1",
    "rs_regime_5_20",
    "rs_regime_10_60",
    "rs_regime_20_60",
    "rs_volatility_5_lag_1",
    "rs_volatility_20_lag_1",
    "rs_vol_of_vol_5_lag_1",
    "rs_vol_of_vol_20_lag_1",
    "yz_regime_5_20",
    "yz_regime_10_60",
    "yz_regime_20_60",
    "yz_volatility_5_lag_1",
    "yz_volatility_20_lag_1",
    "yz_volatility_60_lag_1",
    "yz_vol_of_vol_5_lag_1",
    "yz_vol_of_vol_20_lag_1",
    "yz_vol_of_vol_60_lag_1",
    "yz_volatility_ratio_5_20",
    "yz_volatility_ratio_20_60",
    "day_of_week",
    "month",
    "market_movement",
    "spy_lag_return_1",
    "spy_lag_return_5",
    "spy_lag_return_20",
    "spy_volatility_20",
    "spy_drawdown_252",
    "spy_sma_ratio_50",
    "spy_sma_ratio_200",
    "spy_return_zscore_252",
    "vix_level",
    "vix_return_lag_1",
    "vix_return_lag_5",
    "vix_return_lag_20",
    "vix_SMA_10",
    "vix_SMA_20",
    "vix_SMA_60",
    "vix_percentile_252",
)
XGB_FEATURES = (
    "Ticker",
    "log_return_lag_1",
    "log_return_lag_2",
    "log_return_lag_3",
    "log_return_lag_5",
    "log_return_lag_10",
    "log_return_lag_20",
    "log_distance_close_vs_SMA_5",
    "log_distance_close_vs_SMA_10",
    "log_distance_close_vs_SMA_20",
    "log_distance_close_vs_SMA_50",
    "ema5_minus_ema20",
    "ema12_minus_ema26",
    "log_return_volatility_5",
    "log_return_volatility_10",
    "log_return_volatility_20",
    "bollinger_upper_distance_10",
    "bollinger_lower_distance_10",
    "bollinger_bandwidth_10",
    "bollinger_upper_distance_20",
    "bollinger_lower_distance_20",
    "bollinger_bandwidth_20",
    "rsi_7",
    "rsi_14",
    "rsi_21",
    "daily_range",
    "range_percentage",
    "candle_body",
    "upper_shadow",
    "lower_shadow",
    "body_percentage",
    "upper_shadow_pct",
    "lower_shadow_pct",
    "volume_pct_change_1",
    "relative_volume_5",
    "relative_volume_20",
    "volume_sma_20",
    "return_x_volume",
    "drawdown_10",
    "drawdown_20",
    "drawdown_50",
    "rolling_window_mdd_10",
    "rolling_window_mdd_20",
    "rolling_window_mdd_50",
    "sharpe_10",
    "sharpe_20",
    "momentum_1",
    "momentum_10",
    "gk_variance_lag_1",
    "gk_variance_lag_5",
    "gk_regime_5_20",
    "gk_regime_10_60",
    "gk_regime_20_60",
    "parkinson_variance_lag_1",
    "parkinson_variance_lag_5",
    "parkinson_regime_5_20",
    "parkinson_regime_10_60",
    "parkinson_regime_20_60",
    "rogers_satchell_variance_lag_1",
    "rogers_satchell_variance_lag_5",
    "rs_regime_5_20",
    "rs_regime_10_60",
    "rs_regime_20_60",
    "gk_variance_mean_5_lag_1",
    "gk_variance_mean_20_lag_1",
    "parkinson_volatility_5_lag_1",
    "parkinson_volatility_20_lag_1",
    "parkinson_vol_of_vol_5_lag_1",
    "parkinson_vol_of_vol_20_lag_1",
    "rs_volatility_5_lag_1",
    "rs_volatility_20_lag_1",
    "rs_vol_of_vol_5_lag_1",
    "rs_vol_of_vol_20_lag_1",
    "yz_variance_lag_1",
    "yz_regime_5_20",
    "yz_regime_10_60",
    "yz_regime_20_60",
    "yz_volatility_5_lag_1",
    "yz_volatility_20_lag_1",
    "yz_volatility_60_lag_1",
    "yz_vol_of_vol_5_lag_1",
    "yz_vol_of_vol_20_lag_1",
    "yz_vol_of_vol_60_lag_1",
    "yz_volatility_ratio_5_20",
    "yz_volatility_ratio_12_26",
    "yz_volatility_ratio_20_60",
    "day_of_week",
    "month",
    "market_movement",
    "spy_lag_return_1",
    "spy_lag_return_5",
    "spy_lag_return_20",
    "spy_volatility_20",
    "spy_drawdown_252",
    "spy_sma_ratio_50",
    "spy_sma_ratio_200",
    "spy_return_zscore_252",
    "vix_level",
    "vix_return_lag_1",
    "vix_return_lag_5",
    "vix_return_lag_20",
    "vix_SMA_10",
    "vix_SMA_20",
    "vix_SMA_60",
    "vix_percentile_252",
)
MLP_FEATURES = (
    "Ticker",
    "log_return_lag_1",
    "log_return_lag_3",
    "log_return_lag_5",
    "log_return_lag_10",
    "log_return_lag_20",
    "log_distance_close_vs_SMA_5",
    "log_distance_close_vs_SMA_10",
    "log_distance_close_vs_SMA_20",
    "log_return_volatility_5",
    "log_return_volatility_10",
    "log_return_volatility_20",
    "bollinger_upper_distance_20",
    "bollinger_lower_distance_20",
    "bollinger_bandwidth_20",
    "rsi_7",
    "rsi_14",
    "range_percentage",
    "body_percentage",
    "upper_shadow_pct",
    "lower_shadow_pct",
    "volume_pct_change_1",
    "relative_volume_5",
    "relative_volume_20",
    "drawdown_20",
    "rolling_window_mdd_20",
    "sharpe_20",
    "yz_volatility_5_lag_1",
    "yz_volatility_20_lag_1",
    "yz_volatility_60_lag_1",
    "yz_vol_of_vol_5_lag_1",
    "yz_vol_of_vol_20_lag_1",
    "yz_vol_of_vol_60_lag_1",
    "parkinson_regime_5_20",
    "parkinson_regime_10_60",
    "parkinson_regime_20_60",
    "parkinson_volatility_5_lag_1",
    "parkinson_vol_of_vol_5_lag_1",
    "rs_regime_5_20",
    "rs_regime_10_60",
    "rs_regime_20_60",
    "rs_volatility_5_lag_1",
    "rs_vol_of_vol_5_lag_1",
    "yz_regime_5_20",
    "yz_regime_10_60",
    "yz_regime_20_60",
    "yz_volatility_ratio_5_20",
    "yz_volatility_ratio_20_60",
    "gk_variance_mean_20_lag_1",
    "gk_regime_5_20",
    "gk_regime_10_60",
    "gk_regime_20_60",
    "parkinson_variance_mean_20_lag_1",
    "rs_variance_mean_20_lag_1",
    "day_of_week",
    "month",
    "market_movement",
    "spy_lag_return_1",
    "spy_lag_return_5",
    "spy_lag_return_20",
    "spy_volatility_20",
    "spy_drawdown_252",
    "spy_sma_ratio_50",
    "spy_sma_ratio_200",
    "spy_return_zscore_252",
    "vix_level",
    "vix_return_lag_1",
    "vix_return_lag_5",
    "vix_return_lag_20",
    "vix_SMA_10",
    "vix_SMA_20",
    "vix_SMA_60",
    "vix_percentile_252",
)

# Columns looked at for outliers, columns that are winsorised, and columns with long tails.
OUTLIER_COLUMNS = (
    "upper_shadow_pct",
    "lower_shadow_pct",
    "drawdown_20",
    "range_percentage",
    "relative_volume_5",
    "log_return_lag_1",
    "bollinger_lower_distance_20",
    "log_return_volatility_5",
)
CLIP_COLUMNS = (
    "upper_shadow_pct",
    "lower_shadow_pct",
    "drawdown_20",
    "range_percentage",
    "relative_volume_5",
    "log_return_lag_1",
    "bollinger_lower_distance_20",
    "bollinger_upper_distance_20",
    "bollinger_bandwidth_20",
    "log_return_volatility_5",
    "volume_pct_change_1",
    "relative_volume_20",
    "body_percentage",
    "gk_variance_mean_5_lag_1",
    "gk_variance_mean_20_lag_1",
    "parkinson_volatility_5_lag_1",
    "parkinson_volatility_20_lag_1",
    "rs_volatility_5_lag_1",
    "rs_volatility_20_lag_1",
    "yz_volatility_5_lag_1",
    "yz_volatility_20_lag_1",
    "yz_volatility_60_lag_1",
    "yz_volatility_ratio_5_20",
    "yz_volatility_ratio_20_60",
    "spy_lag_return_1",
    "spy_lag_return_5",
    "spy_lag_return_20",
    "spy_volatility_20",
    "spy_drawdown_252",
    "spy_sma_ratio_50",
    "spy_sma_ratio_200",
    "spy_return_zscore_252",
    "vix_level",
    "vix_return_lag_1",
    "vix_return_lag_5",
    "vix_return_lag_20",
    "vix_SMA_10",
    "vix_SMA_20",
    "vix_SMA_60",
)
SKEWED_COLUMNS = (
    "log_return_volatility_5",
    "log_return_volatility_10",
    "log_return_volatility_20",
    "bollinger_upper_distance_20",
    "bollinger_lower_distance_20",
    "bollinger_bandwidth_20",
    "range_percentage",
    "upper_shadow_pct",
    "lower_shadow_pct",
    "relative_volume_5",
    "relative_volume_20",
    "drawdown_20",
    "gk_variance_mean_5_lag_1",
    "gk_variance_mean_20_lag_1",
    "parkinson_volatility_5_lag_1",
    "parkinson_volatility_20_lag_1",
    "rs_volatility_5_lag_1",
    "rs_volatility_20_lag_1",
    "yz_volatility_5_lag_1",
    "yz_volatility_20_lag_1",
    "yz_volatility_60_lag_1",
)

PROJECTIONS = {"lr": LR_FEATURES, "xgb": XGB_FEATURES, "mlp": MLP_FEATURES}

# Grids of the two models.
LR_GRID = {"C": (0.001, 0.01, 0.1, 1.0, 10.0), "l1_ratio": (0.0, 0.25, 0.5, 0.75, 1.0)}
XGB_GRID = {"n_estimators": (50, 100, 200), "max_depth": (1, 2, 3), "learning_rate": (0.01, 0.05, 0.1), "subsample": (0.7, 0.8, 1.0), "colsample_bytree": (0.7, 0.8, 1.0)}

DEFAULTS = {
    "stock_features_config": STOCK_FEATURES,
    "spy_features_config": SPY_FEATURES,
    "vix_features_config": VIX_FEATURES,
    "lr_features": LR_FEATURES,
    "xgboost_features": XGB_FEATURES,
    "mlp_features": MLP_FEATURES,
    "outlier_feature_selection": OUTLIER_COLUMNS,
    "clip_columns": CLIP_COLUMNS,
    "skewed_features": SKEWED_COLUMNS,
    "target_variable": "market_movement",
    "training_proportion": 0.8,
    "max_gap_days": 10,
    "metric": "roc_auc",
    "lr_param_grid": LR_GRID,
    "xgb_param_grid": XGB_GRID,
}


def load_parameters(*paths: str | Path) -> dict[str, Any]:
    """The defaults, with what the YAML files (or all *.yml files of a folder) say put in, later files last."""
    import yaml

    out = dict(DEFAULTS)
    for path in map(Path, paths):
        for file in sorted(path.rglob("*.yml")) if path.is_dir() else [path]:
            out |= yaml.safe_load(file.read_text()) or {}
    return out
