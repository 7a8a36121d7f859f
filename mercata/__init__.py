"""mercata: Spark-native marketing and product analytics.

Every operator takes DataFrames and returns a lazy DataFrame. Nothing is
collected to the driver; heavy steps are shuffles, joins, windows and
aggregates that Catalyst plans and AQE re-plans at run time.
"""

from mercata.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
