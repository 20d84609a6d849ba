"""Schemas compiled to Spark: typed columns, JSON text, and exact objects in Arrow batches."""
