"""spendlens: marketing spend / return analytics as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column helpers (numeric coercion, dates, metrics, labels)
sources    readers: CSV exports, header table, driver test-table adapters
operators  detection, normalisation, validation, reports, scoring, budget,
           chart datasets, fact-table maintenance
plans      end-to-end compositions and the named query catalog
streaming  incremental file ingest with Structured Streaming
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
