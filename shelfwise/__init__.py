"""Retail-assortment analytics as plain Spark DataFrame operators."""
