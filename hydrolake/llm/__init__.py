"""Operators for building language-model training corpora.

Each module holds one operator with a general interface and the thin
``opN_*`` query that applies it to the driver's tables; :mod:`catalog`
registers the queries and their SQL.  Nothing else in the library imports
this package.
"""

import sys

from pyspark import cloudpickle

# tasks carry this package's code with them: workers need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
