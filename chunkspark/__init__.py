"""PySpark-native document chunking, structure-aware retrieval and retrieval evaluation."""
