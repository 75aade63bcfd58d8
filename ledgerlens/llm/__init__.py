"""Training-data operators: quality, tokens, archives, near copies, secrets, licences, rules, overlaps and hosts.

Functions that run inside tasks are pickled by value, so workers need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
