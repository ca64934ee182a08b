"""Kindred: item similarity and recommendation analytics on Apache Spark."""
