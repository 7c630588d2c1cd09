"""PySpark-native analytics for population-genomics-style tables."""
