"""Tally auditing on Spark: DataFrame in, DataFrame out."""
