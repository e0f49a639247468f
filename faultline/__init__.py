"""Log triage and root-cause analytics as Spark jobs over tables and streams."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
