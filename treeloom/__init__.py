"""treeloom: a Spark-native engine for reconstructing very large lineage trees.

Functions of this package that run on executors are pickled by value, so a
cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
