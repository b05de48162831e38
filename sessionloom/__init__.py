"""Spark-native analytics over long ordered session transcripts."""
