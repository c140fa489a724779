"""harrier: Spark-native security analytics and training-data operators."""
