"""sparkpanel: weakly supervised text labelling and panel econometrics on Spark.

Every operator takes DataFrames and returns DataFrames.  Heavy work runs as
Spark aggregates, joins and windows; only k x k solves of estimators and a few
scalars ever reach the driver.
"""

from sparkpanel.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
