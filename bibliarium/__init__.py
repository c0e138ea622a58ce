"""Spark-native engine for collections of scholarly records."""
