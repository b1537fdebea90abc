"""Operators of a training-data pipeline: one module per operator, ``queries`` registers them.

Functions that run on executors are pickled by value, so workers need the third-party
libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
