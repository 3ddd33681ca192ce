"""Spark-native analytics for animal tracks: every operator takes and returns DataFrames."""
