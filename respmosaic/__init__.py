"""Response-matrix analytics on Spark.

A response matrix is kept *long* -- one row per ``(entity, item, value)`` -- and every
operator is a function from DataFrame to DataFrame that Catalyst plans and AQE executes.
"""

import sys

from pyspark import cloudpickle

from respmosaic.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
