"""Posting intelligence as Spark jobs: every operator takes DataFrames and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
