"""Code-corpus analytics on Spark: facts about compiled archives as tables, questions about them as joins."""

import sys

from pyspark import cloudpickle

# Partition functions travel to the executors with the plan, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
