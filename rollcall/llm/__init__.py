"""Operators for preparing language-model training data.

Each module is one operator over a table of documents; ``queries`` registers
one query per operator.  Nothing else in the library imports this package.

The functions that run inside Python workers travel with the task instead of
being imported there, so executors need numpy and pyarrow but no copy of the
library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
