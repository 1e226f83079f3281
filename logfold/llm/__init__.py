"""Operators for preparing training text; nothing else in the package imports them.

Functions that run in tasks are sent with their code, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
