"""PySpark-native analytics for token-holder data: DataFrame in, DataFrame out."""
