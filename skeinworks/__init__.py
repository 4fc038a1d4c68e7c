"""A PySpark-native engine for listing data: sources, record operators and query plans."""
