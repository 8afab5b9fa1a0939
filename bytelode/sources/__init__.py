"""The two archive containers as tables."""
