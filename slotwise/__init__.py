"""A PySpark analytics engine for time series of published facility readings."""
