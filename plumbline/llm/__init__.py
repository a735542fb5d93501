"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers them under the driver's names and ``oracles`` holds the DuckDB SQL
where SQL can express the result. Nothing else in the library imports this
subpackage.
"""

import sys

from pyspark import cloudpickle

# Task closures carry this subpackage's functions by value, so executors need
# no copy of the library on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
