"""PySpark operators for timestamped media and telemetry streams."""

import sys

from pyspark import cloudpickle

# Step functions and UDFs travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
