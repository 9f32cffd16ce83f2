"""lumidex: a PySpark-native analytics engine for personal media catalogues."""
