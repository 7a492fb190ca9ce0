"""Vessel-track analytics on Spark: DataFrame-to-DataFrame operators."""
