"""Episodic trajectory analytics on PySpark."""
