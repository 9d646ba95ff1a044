"""marketlens: order analytics on Spark DataFrames.

Layers
------
sources    bronze/silver schemas, raw-text ingest, the stand-in adapter for the
           driver's test tables, and the table catalog.
functions  Column -> Column helpers (cleaning, dates, exact averages, labels,
           scalable global rank / ntile, great-circle distance).
operators  DataFrame -> DataFrame data operators, one module per phase.
plans      the query registry (``queries()``) and its SQL oracle twins.
streaming  the reference is batch only; see the module docstring.
"""

__version__ = "0.1.0"
