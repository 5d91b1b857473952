"""kgloom: knowledge-graph building and analysis as PySpark DataFrame transforms."""
import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
