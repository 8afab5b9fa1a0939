"""Compression of arriving files."""
