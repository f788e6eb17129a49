"""vardens: density clustering with varying density on Spark, for points and text.

Functions shipped to Python workers (``mapInPandas`` / ``applyInPandas`` helpers) are
pickled by value, so executors need no installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
