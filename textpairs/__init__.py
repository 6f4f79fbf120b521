"""textpairs: Spark-native sentence-pair corpus engine."""
