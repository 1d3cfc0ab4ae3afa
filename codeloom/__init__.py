"""A PySpark-native engine for code navigation, retrieval and log compression."""
