"""Typed configuration: windows, thresholds, split boundaries, smoothing."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference for equal results.
# Default past-only windows (label -> seconds): 10 minutes, 1 hour, 24 hours, 7 days.
DEFAULT_WINDOWS: dict[str, int] = {"10m": 600, "1h": 3600, "24h": 86400, "7d": 604800}
# Alert thresholds: score >= 0.7 is HIGH, >= 0.3 is MEDIUM, else LOW.
T_HIGH = 0.7
T_MEDIUM = 0.3
# Historical fraud-rate smoothing (fraud_past + alpha) / (labeled_past + beta).
RATE_ALPHA = 1.0
RATE_BETA = 10.0
# Target encoding smoothing.
TE_SMOOTHING = 100.0
# Model-matrix sentinels.
NUM_MISSING = -999.0
CAT_MISSING = "__missing__"
# Calibrated probability clip range.
CLIP_LO = 1e-6
CLIP_HI = 1.0 - 1e-6
# z-score epsilon.
Z_EPS = 1e-6
# PSI smoothing and status bands.
PSI_EPS = 1e-6
PSI_STABLE = 0.10
PSI_MODERATE = 0.25
# Recommended action per level (codes of our own).
ACTIONS = {"HIGH": "hold-for-review", "MEDIUM": "ask-second-factor", "LOW": "pass"}
# Columns that a drift report checks by default, per kind of check.
DRIFT_CHECKS: dict[str, tuple[str, ...]] = {
    "numeric": ("amount",),
    "categorical": ("card_brand", "mcc_str"),
    "missing": ("amount", "card_brand", "mcc_str", "merchant_id"),
    "new": ("merchant_id", "mcc_str"),
}
# Columns never used as model features (ids, target, PII, metadata).
EXCLUDE_FEATURES = frozenset({
    "id", "date", "transaction_id_str", "has_label", "is_fraud",
    "card_number", "address", "mcc_description",
})
# Ids and PII we exclude in addition (decided in SURVEY quirk Q4).
EXTRA_EXCLUDE = frozenset({"cvv", "card_id", "client_id", "id_card", "client_id_card", "id_user"})


@dataclass(frozen=True)
class SplitBoundaries:
    """train: date <= train_end; val: train_end < date <= val_end; test: date >= test_start.

    Boundaries are midnight instants (reference behaviour); ``end_of_day``
    moves train_end/val_end to the last microsecond of that day.
    """
    train_end: str = "2017-12-31"
    val_end: str = "2019-12-31"
    test_start: str = "2020-01-01"
    end_of_day: bool = False


@dataclass(frozen=True)
class Thresholds:
    high: float = T_HIGH
    medium: float = T_MEDIUM
