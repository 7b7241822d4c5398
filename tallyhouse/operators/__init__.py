"""The analyses: DataFrame in, DataFrame out."""
