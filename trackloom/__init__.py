"""Spark operators for trajectory-conditioned video datasets.

Everything is a function from DataFrame to DataFrame.  Sub-packages:

* ``functions``  column expressions and generic order/quantile building blocks
* ``operators``  dataset operators (validate, select, join, raster, metrics)
* ``sources``    readers and writers
* ``streaming``  Structured Streaming forms
* ``plans``      named queries over the shared test tables, each with SQL
"""

__version__ = "0.1.0"
