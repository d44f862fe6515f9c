"""Evidence-grounded document analytics on Spark: DataFrame in, DataFrame out."""
