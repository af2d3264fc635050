"""abacora: a PySpark-native analytics engine for learning-assessment data."""
