"""Spatial reconstruction analytics as DataFrame plans, with a corpus toolkit beside it.

Sub-packages: ``kernels`` (geometry of one feature in numpy), ``operators``
(DataFrame in, DataFrame out), ``plans`` (named queries with their SQL) and
``sources`` (readers and writers).
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
