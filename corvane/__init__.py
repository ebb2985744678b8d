"""A PySpark-native analytics library: statistics, models and array algebra over DataFrames."""

__version__ = "0.1.0"
