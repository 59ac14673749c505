"""A PySpark-native engine for news analytics and corpus preparation."""
