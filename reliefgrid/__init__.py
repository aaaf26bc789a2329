"""Rasters, contours and meshes as Spark tables.

Every stage is a DataFrame -> DataFrame function; see the subpackages ``sources``,
``functions``, ``operators``, ``plans`` and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Python workers get the package's helpers with the task itself, so a job also runs where
# the package is not installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
