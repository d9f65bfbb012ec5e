"""Training-data operators: one module per operator, `queries.py` registers them.

Functions of this subpackage run inside Python workers.  They are pickled by value, so an
executor needs no copy of the repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
