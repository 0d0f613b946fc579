"""Operators of a training-data pipeline over a documents table (doc_id, text, lang, source, n_chars)."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
