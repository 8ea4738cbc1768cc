"""Training-data operators. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import findloom

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(findloom)
