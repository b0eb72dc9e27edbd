"""PySpark-native analytics over digital-evidence tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
