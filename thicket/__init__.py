"""Thicket: hierarchical work-graph analytics on PySpark."""
