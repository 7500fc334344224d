"""Tokenization analytics over text corpora, as Spark DataFrame jobs.

Layers, bottom up:

* ``functions``  column builders: normalisation, pieces, opcodes, scoring
* ``sources``    corpus scans, result files, saved vocabularies, report sinks
* ``operators``  DataFrame -> DataFrame operators built from the columns
* ``plans``      the three end-to-end reports and the query registry
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task-side helpers travel inside the job, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
