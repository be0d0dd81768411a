"""Tessera: disclosure-intelligence analytics as Spark jobs."""
