"""Operations for building language-model training data, as Spark jobs.

Nothing outside this package imports it. Its functions run inside Spark tasks
by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
