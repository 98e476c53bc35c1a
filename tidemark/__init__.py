"""Time-series pattern analytics on Spark, and operators for training data."""
