"""Shelf price-tag analytics as Spark DataFrame operators."""
