"""Orrery: architecture-graph analytics and corpus preparation as PySpark DataFrames."""
