"""Registries, query plans and iterative plans."""
