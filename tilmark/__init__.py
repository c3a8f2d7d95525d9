"""Tilmark: Spark-native alignment of noisy transcripts with a canonical verse corpus."""
