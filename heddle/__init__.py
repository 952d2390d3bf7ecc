"""Decision-data analytics on Spark: DataFrame and SQL plans for building, checking and reporting datasets."""
