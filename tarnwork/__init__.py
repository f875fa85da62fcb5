"""Analytics queries written for Spark: DataFrame in, DataFrame out."""
