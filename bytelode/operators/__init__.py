"""Operators on tables with a binary payload: chunking, byte statistics, compression, verification."""
