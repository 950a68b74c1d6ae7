"""reelforge: Spark-native operators for building multimodal media datasets.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL built-ins (window functions, higher-order functions, joins and
aggregates).  Nothing is collected to the driver.
"""

__version__ = "0.1.0"
