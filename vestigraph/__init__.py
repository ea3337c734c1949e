"""Versioned, time-aware knowledge graphs, retrieval and rules as Spark programs."""
