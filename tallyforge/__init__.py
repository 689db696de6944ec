"""Settlement audit engine on PySpark, with a subpackage of corpus operators.

Functions of this package that run inside Python workers are shipped by value, so that executors
need no copy of it.
"""

from pyspark import cloudpickle

import tallyforge as _self

cloudpickle.register_pickle_by_value(_self)
