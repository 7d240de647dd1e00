"""tickforge: OHLCV bar analytics as Spark DataFrame transforms.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` so that
pipelines compose with ``DataFrame.transform``; nothing collects bar data to
the driver.
"""

__version__ = "0.1.0"
