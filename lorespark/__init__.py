"""Hybrid knowledge retrieval and knowledge-base analytics as Spark plans."""
