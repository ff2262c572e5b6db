"""A PySpark engine for features of multi-subject array and time-series data."""
