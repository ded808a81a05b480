"""Market-tick anomaly analytics as DataFrame-in, DataFrame-out Spark operators."""
