"""Schemaloom: schema-driven record processing on PySpark.

The package ships its functions to executors by value, so a cluster needs no
copy of it on the workers' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
