"""A PySpark-native analytics engine for asset portfolios and text corpora."""
