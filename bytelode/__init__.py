"""Byte analytics, archiving and corpus preparation on Spark."""
