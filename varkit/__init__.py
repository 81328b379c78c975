"""varkit: variable profiling, trend tables, treatment and reduction on Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame (reducers also return a
plain list of column names).  The data work runs as Spark SQL expressions,
aggregates and windows on the executors; only small summaries (per-variable
statistics, bucket boundaries, k x k moment matrices) reach the driver.
"""

import sys
from importlib import import_module

from pyspark import cloudpickle as _cloudpickle

# The one-scan moment sums run Python on the executors; it travels by value, so Python
# workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EXPORTS = {
    "numerical_categorical_division": "varkit.functions.columns",
    "fold_nan": "varkit.functions.columns",
    "pct_name": "varkit.functions.columns",
    "roles_from_header": "varkit.functions.columns",
    "to_long": "varkit.functions.columns",
    "profile": "varkit.operators.profile",
    "numeric_trends": "varkit.operators.trends",
    "categorical_trends": "varkit.operators.trends",
    "trend_tables": "varkit.operators.trends",
    "binned_line": "varkit.operators.trends",
    "box_stats": "varkit.operators.trends",
    "column_percent": "varkit.operators.trends",
    "graphical_tables": "varkit.operators.trends",
    "write_result": "varkit.sources.tables",
    "read_table": "varkit.sources.tables",
    "save_model": "varkit.operators.score",
    "load_model": "varkit.operators.score",
    "centred_vif": "varkit.operators.reduce",
    "ols_no_intercept": "varkit.operators.reduce",
    "cap_floor": "varkit.operators.treat",
    "dummies": "varkit.operators.treat",
    "dummies_binary": "varkit.operators.treat",
    "dummies_sparse": "varkit.operators.treat",
    "smooth_tails": "varkit.operators.treat",
    "correlation_matrix": "varkit.operators.moments",
    "gram_matrix": "varkit.operators.moments",
    "correlation_clusters": "varkit.operators.reduce",
    "varclus": "varkit.operators.reduce",
    "vif_table": "varkit.operators.reduce",
    "vif_reduction": "varkit.operators.reduce",
    "vif_reduction_corr": "varkit.operators.reduce",
    "backward_selection": "varkit.operators.reduce",
    "fit_gbt": "varkit.operators.score",
    "score_event_prob": "varkit.operators.score",
    "gains_table": "varkit.operators.score",
    "match_buckets": "varkit.operators.score",
    "feature_importance": "varkit.operators.score",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
