"""tidewright: news-sentiment and factor-portfolio analytics as Spark jobs.

Everything is a function from DataFrames to DataFrames (or to Columns); Catalyst
plans the physical work.  Sub-packages: ``functions`` (Column helpers), ``sources``
(readers, cleaning, sinks), ``operators`` (joins, windows, rollups, statistics),
``streaming`` (Structured Streaming forms), ``plans`` (registered queries with their
SQL) and the optional ``llm`` (operators for language-model training data), which
nothing here imports.

Functions that run in Python workers travel by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
