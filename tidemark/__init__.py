"""Spark jobs for point-in-time panel research: DataFrame in, DataFrame out."""
