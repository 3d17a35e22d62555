"""Spatial-imaging relations and operators on PySpark."""
