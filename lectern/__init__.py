"""Spark-native analytics over lecture media tables: frames, slides, transcripts, catalogs, runs."""
