"""Readers and writers: JSON lines, Parquet, Arrow IPC, text reports, link pages."""
