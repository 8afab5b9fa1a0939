"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries`` holds the registered
queries and their SQL."""
