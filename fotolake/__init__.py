"""Analytics over large catalogs of image files, written with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with their code, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from fotolake.schemas import Catalog  # noqa: E402

__all__ = ["Catalog"]
