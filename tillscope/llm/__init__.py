"""Operators that prepare training text: counting, deduplication, filters, scans and encoding."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code with them, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
