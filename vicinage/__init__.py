"""Spatial community analytics on Spark: DataFrame operators over cells, expression values and graphs of neighbourhoods.

Functions that tasks call travel with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
