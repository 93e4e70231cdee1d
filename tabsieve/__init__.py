"""tabsieve: feature audit, feature engineering, selection and evaluation on Spark.

Every operator is a DataFrame expression, join, window or aggregation.
Fitted state (top-k lists, medians, level tables) is either a handful of
driver-side literals or a small DataFrame joined back with a checked
broadcast.
"""

from tabsieve.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
