"""tessera: a Spark-native engine for time-series measurements."""
