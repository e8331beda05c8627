"""Operations of a training-data pipeline. Functions sent to tasks carry their code, so executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
