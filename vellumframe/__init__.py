"""A PySpark-native engine for structured documents: pages, lines, markup trees, links and corpus conventions."""
