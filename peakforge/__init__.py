"""Spark-native analytics over large collections of tandem mass spectra."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors need not have the package: functions that they run are sent whole
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
