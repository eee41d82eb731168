"""Training-data operators on PySpark.  Nothing outside this subpackage imports it."""
