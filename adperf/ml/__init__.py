"""Model training, attribution and persistence.

Functions that run on executors travel with the task, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
