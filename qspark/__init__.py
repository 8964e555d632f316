"""A PySpark-native engine for columnar and time-series queries."""
