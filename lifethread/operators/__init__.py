"""Relational, ordered, graph, similarity and clustering operators."""
