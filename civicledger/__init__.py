"""civicledger: a PySpark-native analytics engine for public-spending accountability."""
