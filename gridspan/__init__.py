"""Exploring, reshaping, comparing and converting large tables on Spark."""
