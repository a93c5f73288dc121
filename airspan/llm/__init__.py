"""Operators for preparing training text. Nothing else in the package imports this subpackage.

Functions that run on executors are sent with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
