"""tessella: a Spark-native analytics engine with a small SQL dialect and a snapshot-log table store."""
