"""Palaver: analytics over threaded online discussions, as Spark jobs."""

__version__ = "0.1.0"
