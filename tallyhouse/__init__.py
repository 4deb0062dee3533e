"""A PySpark-native engine for activity-log analytics and passage retrieval."""
