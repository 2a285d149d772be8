"""Chat moderation analytics on Spark: score messages, watch users, train scorers."""

import sys

from pyspark import cloudpickle

from banterscope.config import PipelineConfig

# The little Python that runs in tasks travels with the task, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PipelineConfig"]
