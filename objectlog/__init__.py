"""objectlog: a PySpark-native analytics engine for object-centric event logs."""
