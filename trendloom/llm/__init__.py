"""Training-data operators: dedup, decontamination, classifiers, filters and tokenisation over text tables.

The worker-side functions of this subpackage travel by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
