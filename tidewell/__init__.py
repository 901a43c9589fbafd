"""A Spark-native engine for session-event lakehouses."""
