"""Scalar expressions of the dialect as Spark SQL."""
