"""A PySpark-native engine for document knowledge graphs and their analytics."""
