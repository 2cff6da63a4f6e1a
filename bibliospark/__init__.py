"""bibliospark: document-library analytics as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel inside the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
