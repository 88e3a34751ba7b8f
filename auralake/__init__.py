"""Spark-native analytics over audio-quality measurements."""
