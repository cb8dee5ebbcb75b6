"""Run options: the thresholds every operator reads.

Defaults are the reference behaviour; every field can be overridden per call
with ``Options(...).replace(field=value)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace as _replace


@dataclass(frozen=True)
class Options:
    # --- fixed values: the reference's thresholds and sizes ---
    seed: int = 42
    test_size: float = 0.2
    cv_folds: int = 5
    max_tuning_iterations: int = 12
    allow_polynomial_features: bool = True
    max_polynomial_numeric_features: int = 4
    outlier_clip_iqr: float = 1.5
    missing_column_threshold: float = 0.95
    # profile thresholds
    missing_flag_ratio: float = 0.2
    classification_max_distinct: int = 20
    correlation_flag: float = 0.9
    correlation_drop: float = 0.98
    imbalance_majority: float = 0.75
    minority_f1_ratio: float = 0.35
    # explanation sample sizes (reference: 200 rows, 50 background)
    explain_rows: int = 200
    background_rows: int = 50
    permutation_repeats: int = 5
    pdp_grid_points: int = 100
    # --- end of fixed values; scale knobs ---
    exact: bool = True                 # exact quantiles/distincts; False -> sketches
    quantile_accuracy: int = 100_000    # approx_percentile accuracy used to bound the exact refine pass
    cv_parallelism: int = 8

    def replace(self, **kw) -> "Options":
        return _replace(self, **kw)


DEFAULT = Options()
