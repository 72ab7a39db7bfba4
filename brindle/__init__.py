"""brindle: a PySpark-native analytics engine."""
