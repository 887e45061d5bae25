"""lumenveil: a PySpark-native engine for media-privacy and corpus analytics."""
