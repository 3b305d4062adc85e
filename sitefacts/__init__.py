"""Spark-native site-facts engine: crawled pages in, reviewable property records out."""
