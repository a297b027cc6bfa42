"""Document analytics on Spark: DataFrame-first operators over a corpus."""
