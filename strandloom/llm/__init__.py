"""Operators for language-model training text; nothing else in the library imports this subpackage."""
