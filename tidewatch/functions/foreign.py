"""Scoring with models from outside Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def proba_udf(model, positive_index: int = 1):
    """Column function over an array of features, scored batch by batch.

    Uses ``predict_proba`` where the model has it, else the sigmoid of
    ``decision_function``.
    """
    @F.pandas_udf("double")
    def proba(features: pd.Series) -> pd.Series:
        if features.empty:
            return pd.Series(dtype="float64")
        x = np.stack(features.to_numpy())
        if hasattr(model, "predict_proba"):
            p = np.asarray(model.predict_proba(x))
            return pd.Series(p[:, positive_index] if p.ndim == 2 else p)
        return pd.Series(1.0 / (1.0 + np.exp(-np.asarray(model.decision_function(x), dtype=float))))

    return proba
