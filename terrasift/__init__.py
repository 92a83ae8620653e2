"""Spark-native raster, vector and fault-graph analytics, with a text-corpus subpackage (``llm``)."""
