"""Training-data operators: chat formatting, de-duplication, tokenisation, PII,
quality, packing, toxicity and token storage over document tables.

Nothing outside this subpackage imports it.  Functions that run on executors
travel with the task, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
