"""Operators for training-data pipelines.

Nothing else in the library imports this package. Its task-side functions
are shipped by value, so workers need the third-party libraries named in the
README but not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
