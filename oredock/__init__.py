"""Archive, codec and corpus operators for PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from oredock.functions import codecs, formats  # noqa: E402
from oredock.operators import chunks, entropy, lz77  # noqa: E402
from oredock.sources import archive, tree  # noqa: E402
from oredock.streaming import chunker  # noqa: E402

__all__ = ["archive", "chunker", "chunks", "codecs", "entropy", "formats", "lz77", "tree"]
