"""Episodic-memory analytics as PySpark DataFrame jobs."""
