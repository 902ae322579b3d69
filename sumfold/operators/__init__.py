"""Algebras, exact aggregates, sketches and similarity operators."""
