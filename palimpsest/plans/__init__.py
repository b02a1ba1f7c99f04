"""Compositions: reports, retrieval, decisions, erasure."""
