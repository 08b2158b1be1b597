"""hourglass: time-series preparation, forecast baselines and answer auditing on Spark.

DataFrame in, DataFrame out.  See README.md for the operator map.
"""

__version__ = "0.1.0"
