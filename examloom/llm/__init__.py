"""Training-data operators: sharding, quality, URL filters, mixing, decontamination, search, joins, licenses, lines, LM,
conversation tries, packing, whitening.

Names of columns that start with an underscore are reserved for the operators' own use.
"""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
