"""Spark-native analytics for collections of scientific papers."""
