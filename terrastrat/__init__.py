"""Spark-first analytics over point catalogues and gridded evidence."""
