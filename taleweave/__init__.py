"""A Spark-native engine for narrative consistency analytics."""
