"""A Spark-native log analytics engine."""
