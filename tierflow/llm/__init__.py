"""Operators that prepare language-model training text, each a Spark job.

Functions sent to Python workers are pickled by value, so executors need numpy,
pyarrow and the packages an operator names, but not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
